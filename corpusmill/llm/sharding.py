"""Shards by fixed virtual slots, in DataFrame and SQL functions only.

Records hash into thousands of fixed slots; bytes are summed by slot; a small versioned map says which shard
holds which slot. Balancing edits the map, never the hash: a shard above its share gives up slots and the map
gains a version. Rows meet the map in a broadcast join (one row a slot, so its size is fixed), and the
documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, staged

SLOTS = 8192


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit(""))).cast("long")


def virtual_slot(keys: list[Column], n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """``(virtual_slot, bytes, rows)`` from ``records(virtual_slot, size, copies)``: at most one row a slot."""
    return records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def initial_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return loads.select("virtual_slot", F.pmod(F.col("virtual_slot"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``slot_map(virtual_slot, shard, version)`` for the given bytes by slot.

    A shard keeps its largest slots while they fit into an equal share; the rest goes, largest first, to the
    shard that has least. Only moved slots change. Shards that no slot names yet take part, so growing is an
    edit with a larger ``n_shards``. The edit is one SQL fold over at most as many entries as there are slots.
    """
    with_load = slot_map.join(loads, "virtual_slot", "left").select(
        "virtual_slot", "version", F.when(F.col("shard") < n_shards, F.col("shard")).alias("shard"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    in_order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / n_shards
    judged = with_load.withColumn("stays", F.col("shard").isNotNull() & (F.sum("bytes").over(in_order) <= share))
    state = judged.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"),
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "virtual_slot"))))).alias("pool"),
    )
    held = f"transform(sequence(0, {n_shards - 1}), s -> aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.bytes))"
    least = "cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)"
    fold = f"""aggregate(pool,
        named_struct('loads', {held}, 'moves', cast(array() as array<struct<virtual_slot:int,to:int>>)),
        (acc, x) -> named_struct(
            'loads', transform(acc.loads, (l, i) -> if(i = {least}, l + x.bytes, l)),
            'moves', concat(acc.moves, array(named_struct('virtual_slot', x.virtual_slot, 'to', {least})))))"""
    moves = state.select(F.inline(F.expr(f"({fold}).moves")))
    return with_load.join(F.broadcast(moves), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version")
    )


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Stores a version of the map; earlier versions stay readable, and writing a version again replaces it alone."""
    slot_map.select("virtual_slot", "shard").write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(virtual_slot, shard, version)`` of a version of the stored map, the newest by default."""
    stored = spark.read.parquet(path).select("virtual_slot", "shard", "version")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(docs: DataFrame, slot_map: DataFrame, keys: list[Column], n_slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard`` (columns of these names are replaced); a narrow operation.

    Other columns are carried inside a struct, so no name can clash. A slot that the map lacks gives a null shard.
    """
    rows = docs.select(virtual_slot(keys, n_slots).alias("virtual_slot"), F.struct("*").alias("row"))
    out = rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot", "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("virtual_slot", "shard")], "virtual_slot", "shard")


def digest(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS) -> DataFrame:
    """Query op9, law ``bytes``: shards 0 to ``n_shards`` - 1 of nearly equal size.

    Version 0 of the map deals the slots in turn, version 1 is its edit for the bytes that were counted; both are stored
    in the shared folder, and rows go where the newest stored version says. ``slot`` numbers the rows of a shard from 0
    without gaps: slots of the map come in order, each with an offset, and rows are numbered inside their slot. Equal
    records (id and text alike) are counted before the shuffle and expanded after it, so no number of repeats meets in
    one task. A null text has size 8 and the CRC of no bytes, a null id hashes by its text; an empty table gives an empty
    result. ``grown_shard`` is null under this law.
    """
    spark = docs.sparkSession
    records = docs.select("doc_id", record_size(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"))
    records = records.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    keys = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    records = staged(records.withColumn("virtual_slot", virtual_slot(keys, n_slots)), "records")
    loads = staged(slot_bytes(records), "loads")
    path = shared_path(spark, "slot-map")
    write_map(initial_map(spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot")), n_shards), path, 0)
    write_map(rebalanced(read_map(spark, path, 0), loads, n_shards), path, 1)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = read_map(spark, path).join(loads, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("virtual_slot").orderBy(F.xxhash64("size", "text_crc32", "doc_id"), "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = records.withColumn("inside", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(F.broadcast(placed), "virtual_slot")
    numbered = numbered.withColumn("slot", F.col("first") + F.col("inside"))
    out = numbered.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
