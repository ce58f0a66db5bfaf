"""What several operators of this subpackage share: tables, shared storage, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a session on one machine (``local[..]``) gets a folder of our own; on a cluster that is an error,
    since executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/corpusmill"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; its folder is then the cluster's to clean
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is removed."""
    path = f"{shared_root(spark)}/corpusmill-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts the lineage with a copy that survives the loss of executors, and keeps a costly input from
    being computed once per use. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u long, v long)``; the component is its smallest node.

    Alternating stars: a node first hands its larger neighbours to the least node that it knows, itself included, then
    every node hands its smaller neighbours to the least of them. Edges are never more than before, distances shrink
    by a factor in each round (a path of 10 000 nodes takes 15), and what no round changes is one star a component,
    around its smallest node. Least neighbours are aggregates with map-side combine, so a hub costs no more than its
    partial rows. Rounds are written to shared storage, and the one before is removed. Nulls and loops are ignored; an
    empty input gives an empty result.
    """
    spark = edges.sparkSession
    least, greatest = F.least("u", "v"), F.greatest("u", "v")
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("a").cast("decimal(38,0)") - F.col("b")).alias("s"))
    path = shared_path(spark, "edges")
    now = staged(edges.where("u <> v").select(greatest.alias("a"), least.alias("b")).distinct(), "edges", path)
    seen = now.select(state).first()[0]
    while seen["n"]:
        nearest = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        nearest = nearest.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = now.join(nearest, now.b == nearest.node).select("a", F.col("m").alias("b"))
        lowest = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = large.join(lowest, large.a == lowest.node).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        next_path = shared_path(spark, "edges")
        now = staged(small.unionByName(lowest.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "edges", next_path)
        _remove(spark, path)
        path, before = next_path, seen
        seen = now.select(state).first()[0]
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
