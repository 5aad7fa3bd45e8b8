"""Script normalisation for Arabic and Latin text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col, strip

#: Letters that are unified, marks that go, and letters of Persian with their counterparts.
ALEF, ALEF_TO = "إأآ", "ا"
YAA, YAA_TO = "ى", "ي"
MARKS = "ؘؙؚؗ" + "ًٌٍَُِّْ"
TATWEEL = "ـ"
PERSIAN, PERSIAN_TO = "گچپژ", "كجبز"
#: Fixed values of the stricter unification for extracted pages.
PAGE_FROM, PAGE_TO = "إأٱآىةؤئ", "اااايهءء"


def normalized(
    c: str | Column, *, alef: bool = True, yaa: bool = True, diacritics: bool = True, tatweel: bool = True, persian: bool = True, elongation: bool = True
) -> Column:
    """Unify letters, drop marks, shorten runs of one character to two, then strip.

    None of the letters that are put in is one that another rule takes out, so all but the last rule
    are a single pass over the characters. Null and empty texts stay as they are.
    """
    swap = [(ALEF, ALEF_TO * len(ALEF))] * alef + [(YAA, YAA_TO)] * yaa + [(PERSIAN, PERSIAN_TO)] * persian
    drop = MARKS * diacritics + TATWEEL * tatweel
    letters = "".join(a for a, _ in swap) + drop
    # a look at the range in which the letters lie costs a fraction of what translating each character does
    out = F.when(F.rlike(col(c), F.lit(f"[{min(letters)}-{max(letters)}]")), F.translate(col(c), letters, "".join(b for _, b in swap))).otherwise(col(c)) if letters else col(c)
    if elongation:
        out = shortened(out)
    return F.when(F.length(col(c)) > 0, strip(out)).otherwise(col(c))


def shortened(c: str | Column) -> Column:
    """Runs of three or more of one character (not a line feed) become two."""
    return F.regexp_replace(col(c), r"(?d)(.)\1{2,}", "$1$1")


def unified_page_text(c: str | Column) -> Column:
    """Alef, yaa, haa and hamza forms unified, as for extracted pages."""
    return F.translate(col(c), PAGE_FROM, PAGE_TO)


