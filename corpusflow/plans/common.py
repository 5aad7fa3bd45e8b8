"""What the registered queries share: reading tables, collecting queries with their SQL, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def chunks_sql(source: str, size: str = "350", overlap: int = 100, least: int = 50) -> str:
    """CTEs ``cut`` (doc_id, chunks) from a source with (doc_id, text, …)."""
    tail = f"right(a.cur, {overlap})" if overlap else "''"
    return rf"""
    sents AS (SELECT *, list_filter(list_transform(string_split_regex(text, '[.؟!،]'), lambda x: {strip_sql("x")}), lambda x: x <> '') AS ss FROM {source}),
    folded AS (SELECT *, list_reduce(
        list_concat([{{'cur': '', 'out': []::VARCHAR[]}}], list_transform(ss, lambda x: {{'cur': x, 'out': []::VARCHAR[]}})),
        lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 1 < {size} THEN {{'cur': a.cur || b.cur || ' ', 'out': a.out}}
            ELSE {{'cur': {tail} || b.cur || ' ', 'out': CASE WHEN length(a.cur) >= {least} THEN list_append(a.out, {strip_sql("a.cur")}) ELSE a.out END}} END) AS f FROM sents),
    cut AS (SELECT *, CASE WHEN length(f.cur) >= {least} THEN list_append(f.out, {strip_sql("f.cur")}) ELSE f.out END AS chunks FROM folded)"""
