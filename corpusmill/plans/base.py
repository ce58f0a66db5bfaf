"""Registration of queries, and the stand-ins by which driver tables play the domain's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.stats import nearest_level
from ..sources.store import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Labels whose vectors stand for the two poles of each criterion.
POLES = {"two_worlds": (0, 1), "adaptors": (2, 3), "arbitrariness": (4, 5)}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all machines share; removed when the driver ends."""
    return shared_path(spark, name)


def rounded(x: Column | str, digits: int = 5) -> Column:
    """Published figures; + 0.0 makes the negative zero plain."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: five in a row are a paper, and papers are dealt to ten codes."""
    e = table(spark, sf_dir, "embeddings")
    paper = F.floor(F.col("vec_id") / 5).cast("int")
    return e.select((paper % 10).alias("code_number"), F.concat(F.lit("paper/"), paper.cast("string")).alias("pdf_path"), F.lit("chunk").alias("method"), (F.col("vec_id") % 5).cast("int").alias("chunk_idx"), F.col("embedding").alias("vec"), "vec_id", "label")


def pole_map() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(side).alias("pole"), F.lit(label).alias("pole_label")) for c, pair in POLES.items() for side, label in zip(("pos", "neg"), pair, strict=True)]))


def pole_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.geometry import build_poles

    e = table(spark, sf_dir, "embeddings").where(F.col("label") <= 5)
    rows = e.select("label", F.col("embedding").alias("vec"), pole_map().alias("p")).where("p.pole_label = label")
    return build_poles(rows.select("p.criterion", "p.pole", "vec"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics: the mean vector of each label."""
    means = V.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return means.select(F.col("label").alias("topic_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), F.col("mean").alias("vec"))


def graded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged chunks: user = paper, type = criterion, agreement by the value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 7).cast("int").alias("code_number"), F.concat(F.lit("paper/"), F.col("user_id").cast("string")).alias("pdf_path"), F.col("event_type").alias("criterion"), F.col("event_id").alias("chunk_idx"),
        nearest_level(F.col("value") / 50 - 1).alias("agreement"), ((F.col("event_id") % 3 + 1) / 3).alias("confidence"), "ts", "value",
    )


#: SQL of the same stand-ins.
UNIT = """u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
nn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM u GROUP BY vec_id),
un AS (SELECT u.vec_id, u.label, u.i, u.x / nn.n AS x FROM u JOIN nn USING (vec_id))"""
SIDES = """sides(criterion, pole, pole_label) AS (VALUES ('two_worlds','pos',0),('two_worlds','neg',1),('adaptors','pos',2),('adaptors','neg',3),('arbitrariness','pos',4),('arbitrariness','neg',5))"""
PVEC = """pm AS (SELECT criterion, pole, i, avg(x) AS x FROM un JOIN sides ON label = pole_label GROUP BY ALL),
pn AS (SELECT criterion, pole, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM pm GROUP BY ALL),
pv AS (SELECT criterion, pole, i, x / n AS x FROM pm JOIN pn USING (criterion, pole))"""
AXIS = """dv AS (SELECT criterion, i, sum(CASE pole WHEN 'pos' THEN x ELSE -x END) AS x FROM pv GROUP BY ALL),
dn AS (SELECT criterion, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM dv GROUP BY ALL),
ax AS (SELECT criterion, i, x / n AS a FROM dv JOIN dn USING (criterion))"""
GRADED = """lv(i, level) AS (VALUES (0,-1.0::DOUBLE),(1,-0.5::DOUBLE),(2,0.0::DOUBLE),(3,0.5::DOUBLE),(4,1.0::DOUBLE)),
near AS (SELECT event_id, level, row_number() OVER (PARTITION BY event_id ORDER BY abs(value / 50 - 1 - level), i) AS r FROM events, lv WHERE value IS NOT NULL),
g AS (SELECT (user_id % 7)::INT AS code_number, 'paper/' || user_id AS pdf_path, event_type AS criterion, e.event_id AS chunk_idx, near.level AS agreement, (e.event_id % 3 + 1) / 3.0::DOUBLE AS confidence, ts, value
      FROM events e LEFT JOIN near ON near.event_id = e.event_id AND r = 1)"""
