"""Operator 4: token counts without token ids.

A text is cut into pre-tokens (taken together up to the next space, so that their tokens don't depend
on each other). Three steps:

1. ``vocabulary``: the distinct pre-tokens of the whole corpus with their frequencies, each of which is
   tokenised once and keeps only its number of tokens.
2. ``frequencies``: how often each pre-token stands in each document. The ``HEAD`` most frequent ones of
   the corpus, which make up most places, are sent to the tasks with their counts (at most ``HEAD``
   entries of at most ``KEPT_CHARS`` characters, so the size is bounded) and summed there; a document's
   other pre-tokens leave as rows.
3. These rows are joined to the vocabulary by the pre-token and summed for each document. A pre-token
   beyond the head isn't hot: at most one place in ``HEAD`` holds it.

Lists of ids exist for one distinct pre-token at a time only.

Edge cases: null and empty texts have no tokens; special strings inside texts are one token each, as
the library has it by default; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored; ids may have any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, map_columns, most_frequent, saved
from corpusflow.llm.pretokens import KEPT_CHARS, Encoder, Units, encoder_of, groups

#: A text longer than this many tokens is over the limit.
LIMIT = 512
#: At most so many pre-tokens' counts are sent to the tasks.
HEAD = 200_000
#: Characters of text whose pre-tokens are looked up at once.
LOOKED_UP = 1 << 20


def _stretches(encoder: Encoder, texts: list[str]) -> tuple[list[str], list[int], np.ndarray]:
    """The texts without special strings, each stretch's text number, and the special strings in each text."""
    out, owner, special = [], [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own, found = encoder.stretches(text)
        out += own
        owner += [k] * len(own)
        special[k] = len(found)
    return out, owner, special


def vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(piece, occurrences, n_tokens): the distinct pre-tokens of the whole corpus, each counted once.

    Every group of texts sends a row for each of its distinct pre-tokens; the sums meet in one shuffle.
    """

    def split():
        encoder = encoder_of(tokenizer)

        def run(texts: list) -> list[list]:
            pieces, places = [], []
            for _, group in groups(texts):
                units = Units(_stretches(encoder, group)[0])
                pieces += units.distinct
                places += np.bincount(units.codes, minlength=len(units.distinct)).tolist()
            return [pieces, places]

        return run

    def count():
        encoder = encoder_of(tokenizer)

        def run(pieces: list, occurrences: list) -> list[list]:
            return [pieces, occurrences, [encoder.count(x) for x in pieces]]

        return run

    parts = map_columns(docs.select(F.col(text_col).alias("text")), split, "piece string, occurrences long", rows_at_once=None)
    whole = parts.groupBy("piece").agg(F.sum("occurrences").alias("occurrences"))
    return map_columns(whole, count, "piece string, occurrences long, n_tokens long")


def frequencies(docs: DataFrame, tokenizer: str, head: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, known, pieces, times): the tokens of the head's pre-tokens, and the frequencies of all others."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def make():
        encoder, counts = encoder_of(tokenizer), sent.value

        def run(ids: list, texts: list, sizes: list) -> list[list]:
            known, pieces, times, ends = [], [], [], [np.zeros(1, np.int64)]
            for _, group in groups(texts, LOOKED_UP):
                stretches, owner, special = _stretches(encoder, group)
                units = Units(stretches)
                value = np.fromiter((counts.get(u, -1) for u in units.distinct), np.int64, len(units.distinct))
                text_of = np.repeat(np.array(owner, np.int64), np.diff(units.ends))
                kept = value[units.codes] >= 0
                known += (special + np.bincount(text_of[kept], weights=value[units.codes][kept], minlength=len(group)).astype(np.int64)).tolist()
                pairs, n = np.unique(text_of[~kept] * max(1, len(units.distinct)) + units.codes[~kept], return_counts=True)
                rows, codes = np.divmod(pairs, max(1, len(units.distinct)))
                ends.append(ends[-1][-1] + np.searchsorted(rows, np.arange(1, len(group) + 1)))
                pieces.append(pa.array(units.distinct, pa.string()).take(pa.array(codes)))
                times.append(n)
            ends = np.concatenate(ends)
            return [ids, sizes, known, lists(pa.concat_arrays(pieces), ends), lists(pa.array(np.concatenate(times)), ends)]

        return run

    rows = docs.select(F.col(f"`{id_col}`"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return map_columns(rows, make, f"`{id_col}` {kind}, n_bytes long, known long, pieces array<string>, times array<long>", rows_at_once=None)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; ``tokenizer`` is a file the workers can read."""
    known = saved(vocabulary(docs, tokenizer, text_col), "pieces")
    top = most_frequent(known.where(F.length("piece") <= KEPT_CHARS), "occurrences", head).select("piece", "n_tokens").toArrow()
    rows = frequencies(docs, tokenizer, dict(zip(top["piece"].to_pylist(), top["n_tokens"].to_pylist(), strict=True)), id_col, text_col)
    rows = saved(rows.withColumn("cf_row", F.monotonically_increasing_id()), "frequencies")  # written, so a row keeps its number
    pairs = rows.select("cf_row", F.explode(F.arrays_zip("pieces", "times")).alias("p")).select("cf_row", F.col("p.pieces").alias("piece"), F.col("p.times").alias("times"))
    found = pairs.join(known.select("piece", "n_tokens"), "piece").select("cf_row", (F.col("times") * F.col("n_tokens")).alias("known"))
    sums = rows.select("cf_row", "known", F.struct(f"`{id_col}`", "n_bytes").alias("one")).unionByName(found, allowMissingColumns=True)
    whole = sums.groupBy("cf_row").agg(F.sum("known").alias("n_tokens"), F.first("one", ignorenulls=True).alias("one"))
    return whole.select(f"one.`{id_col}`", "one.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
