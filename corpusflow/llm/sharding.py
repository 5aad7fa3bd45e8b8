"""Operator 1: sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into a fixed, large number of virtual slots. The bytes of each slot are summed,
and a map from slot to shard says where a slot lives. The map is a table with versions: version 1
spreads the slots evenly; every rebalancing writes the next version, in which only those slots move
that overloaded shards have to give away. A record's slot never changes.

Edge cases: a null text has no bytes and the CRC of no bytes (0); a null id hashes like any value;
rows that are equal in id and text fall into one slot, and the rows of one slot stay together; an
empty table gives an empty result and a map without loads; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import saved, shared_path

#: Fixed number of virtual slots, and of cells within each slot that number its rows in parallel.
SLOTS = 4096
CELLS = 16
#: Bytes that every record counts besides its text.
OVERHEAD = 16

_SLOT = "struct<bytes:bigint,virtual_slot:int,shard:int>"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, cell): one narrow row for each document."""
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0).cast("long"))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long")
    row = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots * cells)).cast("int")
    return row.withColumn("cell", cell).withColumn("virtual_slot", F.floor(F.col("cell") / cells).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes of each virtual slot; partial sums make this a shuffle of at most one row a slot and task."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal runs of slots."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("virtual_slot"),
        F.floor(F.col("id") * shards / slots).cast("int").alias("shard"),
    )


def rebalanced(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next map: (virtual_slot, shard, bytes), edited from ``current``.

    Taken from the largest slot to the smallest, a slot stays where it is while its shard has room
    below the mean; the others go, in the same order, to whichever shard is least loaded then. The
    fold is over one array with an entry for each virtual slot, whatever the number of records.
    """
    slot = F.struct(F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "virtual_slot", "shard")
    one = current.join(loads, "virtual_slot", "left").agg(F.sort_array(F.collect_list(slot), asc=False).alias("slots"))
    put = "transform(a.loads, (l, i) -> if(i = {0}, l + s.bytes, l))"
    stay = f"""aggregate(slots,
        named_struct('loads', array_repeat(0L, {shards}), 'kept', cast(array() as array<{_SLOT}>), 'free', cast(array() as array<{_SLOT}>)),
        (a, s) -> if(s.shard < {shards} and coalesce(a.loads[s.shard], 0L) + s.bytes <= mean,
            named_struct('loads', {put.format("s.shard")}, 'kept', array_append(a.kept, s), 'free', a.free),
            named_struct('loads', a.loads, 'kept', a.kept, 'free', array_append(a.free, s))))"""
    least = "cast(array_position(a.loads, array_min(a.loads)) - 1 as int)"
    move = f"""aggregate(first.free, named_struct('loads', first.loads, 'kept', first.kept),
        (a, s) -> named_struct('loads', {put.format(least)},
            'kept', array_append(a.kept, named_struct('bytes', s.bytes, 'virtual_slot', s.virtual_slot, 'shard', {least}))))"""
    return (
        one.withColumn("mean", F.expr(f"aggregate(slots, 0L, (a, s) -> a + s.bytes) / {shards}"))
        .withColumn("first", F.expr(stay))
        .select(F.explode(F.expr(f"{move}.kept")).alias("s"))
        .select("s.virtual_slot", "s.shard", "s.bytes")
    )


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Add a version to the map's table. A version that exists is not changed."""
    columns = slot_map.select("virtual_slot", "shard", slot_map["bytes"] if "bytes" in slot_map.columns else F.lit(None).cast("long").alias("bytes"))
    columns.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{path}/version={version}")


def assigned(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard and its gapless place, from 0, within the shard.

    Rows are numbered within their cell, and a cell starts after all earlier cells of its shard.
    The two small tables have a row for each slot and for each cell: fixed sizes, so they are broadcast.
    """
    sizes = rows.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        sizes.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
        .withColumn("start", F.sum("n").over(before) - F.col("n"))
        .select("cell", "shard", "start")
    )
    place = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), "cell").withColumn("slot", F.col("start") + F.col("place"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Hash, sum, edit the map once and look the shards up; the law is ``bytes``: sizes near equal."""
    spark = docs.sparkSession
    rows = saved(records(docs), "records")
    path = shared_path(spark, "slot-map")
    save_map(first_map(spark, shards), path, 1)
    save_map(rebalanced(load_map(spark, path, 1).select("virtual_slot", "shard"), slot_loads(rows), shards), path, 2)
    return assigned(rows, load_map(spark, path, 2)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version"),
    )
