"""Structured Streaming: resumable ingestion of checkpoint files, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a growing folder of JSON files; malformed lines have null keys."""
    return spark.readStream.schema(schema).json(path)


def stream_parquet(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


def ingest(stream: DataFrame, keys: list[str], sink: Callable[[DataFrame], None], checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Rows with whole keys, each key once, in micro-batches over what is there now.

    The checkpoint remembers files and keys, so a restart goes on where the last run ended. ``sink`` gets each batch and
    has to be idempotent, since a batch that failed comes again; an upsert is. ``watermark`` (column, delay) bounds the
    keys that are remembered; repeats that come later than it reach the sink once more.
    """
    rows = stream.where(" and ".join(f"{k} is not null" for k in keys))
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    else:
        rows = rows.dropDuplicates(keys)
    return rows.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_to_store(stream: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Z1 into a table of the store."""
    return ingest(stream, store.key_columns(table), lambda batch: store.upsert(table, batch), checkpoint)


def tumbling_counts(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by window of event time; works on batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Events by session: runs without a pause of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
