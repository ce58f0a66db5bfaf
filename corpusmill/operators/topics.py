"""Topics: nearest centroids, affinities, dominant topics and strata."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .geometry import Geometry, paper_vectors


#: Bytes of centroids that may go to every executor.
MOST_BYTES = 1 << 28


def nearest(vec: Column, centroids: list[tuple[int, np.ndarray]], prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> Column:
    """``struct(similarity, topic_id)`` of the centroid with the greatest dot product, the first among equals; nulls
    for a null vector or without centroids. ``prepare`` turns the rows of a batch into what meets the centroids.

    Centroids go to the executors once, as a matrix of at most MOST_BYTES, and a batch of vectors meets them in one
    product, so rows are not multiplied.
    """
    ids = np.array([t for t, _ in centroids], np.int64)
    matrix = np.array([c for _, c in centroids], np.float64)
    if matrix.nbytes > MOST_BYTES:
        raise ValueError(f"centroids take {matrix.nbytes} bytes, more than the {MOST_BYTES} that may be broadcast")

    @F.arrow_udf("struct<similarity:double,topic_id:int>")
    def best(v: pa.Array) -> pa.Array:
        there, x = V.rows_of(v)
        similarity, topic = np.zeros(len(v)), np.zeros(len(v), np.int32)
        missing = np.ones(len(v), bool)
        if len(there) and len(ids):
            products = (prepare(x) if prepare else x) @ matrix.T
            at = products.argmax(axis=1)
            similarity[there], topic[there], missing[there] = products[np.arange(len(at)), at], ids[at], False
        return pa.StructArray.from_arrays([pa.array(similarity, mask=missing), pa.array(topic, mask=missing)], ["similarity", "topic_id"])

    return best(V.wide(vec))


def collected(centroids: DataFrame, vec: str = "vec") -> list[tuple[int, np.ndarray]]:
    """Centroids of a table on the driver, lowest topic first: one row a topic."""
    return [(r["topic_id"], np.array(r["v"])) for r in centroids.select("topic_id", V.wide(vec).alias("v")).orderBy("topic_id").collect()]


def nearest_by_join(rows: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """J10 for centroids in a table, ``centroids(topic_id, vec)``: ``(keys.., topic_id, similarity)``."""
    best = nearest(F.col("vec"), collected(centroids)).alias("b")
    return rows.select(*keys, best).select(*keys, "b.topic_id", "b.similarity").where("topic_id is not null")


def assign(doc_vectors: DataFrame, centroids: DataFrame, geometry: Geometry, method: str = "chunk") -> DataFrame:
    """``(code_number, pdf_path, chunk_idx, topic_id, similarity)`` in the papers' geometry."""
    known = [(t, geometry.project_array(v)) for t, v in collected(centroids)]
    best = nearest(F.col("vec"), known, geometry.project_rows).alias("n")
    return paper_vectors(doc_vectors, method).select("code_number", "pdf_path", "chunk_idx", best).select("code_number", "pdf_path", "chunk_idx", "n.topic_id", "n.similarity")


def affinities(chunk_topics: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest similarity of a paper's chunks by the topic that they chose, and the first such chunk."""
    return chunk_topics.groupBy(*keys, "topic_id").agg(F.max("similarity").alias("affinity"), F.min("chunk_idx").alias("first_chunk"), F.count(F.lit(1)).alias("n_chunks"))


def dominant(chunk_topics: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., topic_id, affinity)`` of the greatest affinity, the topic met first among equals."""
    best = F.max(F.struct("affinity", (-F.col("first_chunk")).alias("f"), "topic_id")).alias("b")
    return affinities(chunk_topics, keys).groupBy(*keys).agg(best).select(*keys, "b.topic_id", "b.affinity")


def modal(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value by group, the lowest among equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.max(F.struct("__n", (-F.col(value)).alias("v"))).alias("m")).select(*by, (-F.col("m.v")).alias(name))


def top_topics(dominants: DataFrame, n: int) -> DataFrame:
    """The ``n`` topics that dominate most papers; lower ids first among equals."""
    counts = dominants.where("topic_id is not null").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return counts.orderBy(F.desc("n_papers"), "topic_id").limit(n)


def in_strata(dominants: DataFrame, n: int, rest: bool = False) -> DataFrame:
    """Papers whose dominant topic is among the top ``n``, or with ``rest`` is not; papers without one are in neither."""
    top = top_topics(dominants, n).select("topic_id")
    return dominants.where("topic_id is not null").join(top, "topic_id", "left_anti" if rest else "left_semi")


def paper_topics(chunk_topics: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of a paper's topics: the dominant one first, the others by votes, affinity and id."""
    top = dominant(chunk_topics, keys).select(*keys, F.col("topic_id").alias("__d"))
    rows = affinities(chunk_topics, keys).join(top, keys).join(labels.select("topic_id", "label"), "topic_id", "left")
    label = F.coalesce(F.col("label"), F.concat(F.lit("topic "), F.col("topic_id").cast("string")))
    order = F.struct((F.col("topic_id") != F.col("__d")).alias("o"), (-F.col("n_chunks")).alias("c"), (-F.col("affinity")).alias("a"), "topic_id", label.alias("l"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("t")).select(*keys, F.col("t.l").alias("topics"))
