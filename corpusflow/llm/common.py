"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.shared import saved as saved
from corpusflow.shared import shared_path as shared_path


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest ``count``: all that reach it, for the least one that at most ``limit`` rows reach.

    It is read off a histogram of 16 steps for each doubling, so no more than these rows are ever sorted
    or sent, whatever the number of partitions.
    """
    step = F.floor(16 * F.log2(count))
    least, held = None, 0
    for at, n in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += n
        if held > limit:
            break
        least = at
    return df.where(step >= least) if least is not None else df.limit(0)


def filtered(df: DataFrame, column: Column, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows for which the function that ``make`` makes in each task says yes to ``column``; nothing is shuffled."""
    schema = df.schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = make()
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                kept = some.filter(pa.array(keeps(some.column(some.num_columns - 1).to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in df.columns), column.alias("cf_tested")).mapInArrow(run, schema)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled, it never goes whole through the driver.

    Spark estimates a table by its compressed files, so without the hint it may broadcast one that is many times its threshold.
    """
    return df.hint("merge")


def lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """A list for each row: the values up to its end from the end before; ``ends`` begins with 0."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Arrow batches of at most so many rows from now on: whole texts in larger ones take much memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a string column, for Python code that works on bytes."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def batches(rows: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[list[list]]:
    """The columns of each non-empty Arrow batch, or of at most ``size`` of its rows at a time, as Python lists."""
    for batch in rows:
        for at in range(0, batch.num_rows, size or max(1, batch.num_rows)):
            yield [column.to_pylist() for column in batch.slice(at, size).columns]


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, rows_at_once: int | None = 1024) -> DataFrame:
    """Run a function over the columns of each Arrow batch, or of some of its rows at a time.

    ``make()`` is called once per task and returns ``columns in -> columns out`` (lists or Arrow arrays);
    ``schema`` is the Spark schema of what comes out. Nothing is held beyond one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for columns in batches(rows, rows_at_once):
            out = work(*columns)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
