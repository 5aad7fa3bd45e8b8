"""Python readers over files, some rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are read and sent back together; what they hold as Python objects is gone before the next ones.
ROWS = 64


def with_read(files: DataFrame, name: str, read: Callable, schema: str, *inputs: str) -> DataFrame:
    """``files`` with the column ``name`` instead of ``inputs``: what ``read`` makes of these columns of each row.

    Spark hands over batches of 10,000 rows, whose results needn't lie in memory at once: rows come back in batches of ``ROWS``.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import MapType, StructField, StructType, _parse_datatype_string

    kept = [c for c in files.columns if c not in (name, *inputs)]
    made = _parse_datatype_string(schema)
    arrow = to_arrow_type(made)
    maps = [i for i, f in enumerate(made.fields) if isinstance(f.dataType, MapType)] if isinstance(made, StructType) else []

    def whole(row: tuple) -> dict:
        row = list(row)
        for i in maps:
            row[i] = list(row[i].items())
        return {f.name: x for f, x in zip(made.fields, row, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                values = [read(*row) for row in zip(*(c.to_pylist() for c in some.columns[len(kept) :]), strict=True)]
                if isinstance(made, StructType):
                    values = [whole(row) for row in values]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(values, arrow)], names=[*kept, name])

    asked = [F.col(c).alias(f"cf_in_{i}") for i, c in enumerate(inputs)]
    out = StructType([*(files.schema[c] for c in kept), StructField(name, made)])
    return files.select(*kept, *asked).mapInArrow(run, out)
