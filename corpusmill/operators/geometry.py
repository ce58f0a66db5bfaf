"""Contrastive scoring geometry: centre, principal axes, criterion axes; fitted once, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import METHODS

DEFAULT_K, DEFAULT_STRENGTH = 0, 0.5


def l2(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), V.FLOOR)


def method_priority(method: Column, wanted: str = "full") -> Column:
    """The wanted method first, then ``full``, then the others by name."""
    return F.when(method == wanted, 0).when(method == "full", 1).otherwise(2)


def representatives(doc_vectors: DataFrame, keys: tuple[str, ...] = ("code_number", "pdf_path")) -> DataFrame:
    """One vector a paper, the first of ``full``, else the first of what there is; by an aggregate, not a sort."""
    order = F.struct(method_priority(F.col("method")).alias("p"), F.col("method").alias("m"), F.col("chunk_idx").alias("i"), V.wide("vec").alias("v"))
    return doc_vectors.groupBy(*keys).agg(F.min(order).alias("r")).select(*keys, F.col("r.v").alias("vec"))


def paper_vectors(doc_vectors: DataFrame, method: str = "chunk", keys: tuple[str, ...] = ("code_number", "pdf_path")) -> DataFrame:
    """Vectors of the wanted method, of ``full`` where a paper has none of it, else of its first method."""
    rank = F.struct(method_priority(F.col("method"), method).alias("p"), F.col("method").alias("m"))
    best = F.min(rank).over(Window.partitionBy(*keys))
    return doc_vectors.withColumn("__r", rank).withColumn("__b", best).where("__r = __b").drop("__r", "__b")


def method_order(doc_vectors: DataFrame) -> DataFrame:
    """Methods that occur, the usual ones first."""
    usual = F.array(*[F.lit(m) for m in METHODS])
    place = F.array_position(usual, F.col("method"))
    return doc_vectors.select("method").distinct().orderBy(F.when(place == 0, 99).otherwise(place), "method")


@dataclass
class Geometry:
    """Centre, orthonormal rows of the removed subspace, unit axes by criterion, and centred pole widths."""

    mu: np.ndarray
    basis: np.ndarray
    axes: dict[str, np.ndarray]
    within: dict[str, float] = field(default_factory=dict)

    def project(self, vec: Column) -> Column:
        """V3, V7, V1: centred, without the subspace, of unit length."""
        return V.unit(V.without_subspace(V.minus(vec, V.literal(self.mu)), self.basis))

    def project_rows(self, x: np.ndarray) -> np.ndarray:
        """The same for the rows of a matrix."""
        d = np.asarray(x, float) - self.mu
        d = d - (d @ self.basis.T) @ self.basis
        return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), V.FLOOR)

    def project_array(self, v: np.ndarray) -> np.ndarray:
        return self.project_rows(np.asarray(v, float)[None])[0]

    def score(self, vec: Column, criterion: str) -> Column:
        """V5 in this geometry."""
        return V.dot(self.project(vec), V.literal(self.axes[criterion]))


#: Dimensions up to which principal axes come from one Gram matrix; beyond, from repeated passes with few columns.
GRAM, PASSES = 512, 40


def principal_axes(reps: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A2 and V6: mean and top-``k`` principal axes; no axes and no matrix for k <= 0.

    Up to GRAM dimensions tasks add up the centred Gram matrix. Beyond it only its products with k + 8 columns are made,
    in passes that turn these columns towards the axes until they stand still.
    """
    means = V.mean_vector(reps, "vec", []).collect()
    if not means or not means[0]["mean"]:
        raise ValueError("no vectors to fit a geometry on")
    mu = np.array(means[0]["mean"])
    if k <= 0:
        return mu, np.zeros((0, len(mu)))
    if len(mu) <= GRAM:
        gram = V.added(reps, "vec", lambda x: (x - mu).T @ (x - mu))
        n, values, axes = reps.count(), *np.linalg.eigh(gram)
        return mu, axes[:, np.argsort(values)[::-1][: min(k, n, len(mu))]].T
    n = reps.count()
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(len(mu), min(k + 8, len(mu)))))[0]
    for _ in range(PASSES):
        product = V.added(reps, "vec", lambda x, b=basis: (x - mu).T @ ((x - mu) @ b))
        turned = np.linalg.qr(product)[0]
        inner = np.linalg.svd(turned.T @ product)[0]
        turned = turned @ inner
        still = np.abs(np.abs((turned[:, :k] * basis[:, :k]).sum(axis=0)) - 1).max() < 1e-12
        basis = turned
        if still:
            break
    return mu, basis[:, : min(k, n)].T


def shared_direction(axes: list[np.ndarray]) -> np.ndarray:
    """V8: the direction that the axes have most in common, on their side."""
    stacked = np.stack(axes)
    s = np.linalg.svd(stacked, full_matrices=False)[2][0]
    return s if (stacked @ s).sum() >= 0 else -s


def orthogonalised(axis: np.ndarray, shared: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """V9: an axis less a share of its part along the shared direction."""
    return l2(axis - strength * float(axis @ shared) * shared)


def build_axes(poles: dict[str, dict[str, np.ndarray]], mu: np.ndarray, strength: float = DEFAULT_STRENGTH) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Criterion axes of the centred poles, and the cosine between the two poles of each."""
    sides = {c: (l2(p["pos"] - mu), l2(p["neg"] - mu)) for c, p in poles.items()}
    raw = {c: l2(pos - neg) for c, (pos, neg) in sides.items()}
    shared = shared_direction(list(raw.values()))
    return {c: orthogonalised(a, shared, strength) for c, a in raw.items()}, {c: float(pos @ neg) for c, (pos, neg) in sides.items()}


def collect_poles(pole_vectors: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Pole vectors on the driver: two rows a criterion."""
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in pole_vectors.select("criterion", "pole", V.wide("vec").alias("v")).orderBy("criterion", "pole").collect():
        out.setdefault(r["criterion"], {})[r["pole"]] = np.array(r["v"])
    return out


def build_poles(passages: DataFrame) -> DataFrame:
    """A3: ``(criterion, pole, vec)``: unit mean of the unit vectors of ``passages(criterion, pole, vec)``."""
    means = V.mean_vector(passages.withColumn("vec", V.unit(F.col("vec"))), "vec", ["criterion", "pole"])
    return means.select("criterion", "pole", V.unit(F.col("mean")).alias("vec"))


def fit(doc_vectors: DataFrame, pole_vectors: DataFrame, k: int = DEFAULT_K, strength: float = DEFAULT_STRENGTH) -> Geometry:
    """Geometry of the papers; controls and centroids never enter it."""
    mu, basis = principal_axes(representatives(doc_vectors), k)
    axes, within = build_axes(collect_poles(pole_vectors), mu, strength)
    return Geometry(mu, basis, axes, within)


def score_rows(df: DataFrame, geometry: Geometry, keys: list[str]) -> DataFrame:
    """``(keys.., criterion, e)`` for each vector and criterion; the projection is made once a row."""
    projected = df.select(*keys, geometry.project(F.col("vec")).alias("__d"))
    scores = F.array(*[F.struct(F.lit(c).alias("criterion"), V.dot(F.col("__d"), V.literal(a)).alias("e")) for c, a in geometry.axes.items()])
    return projected.select(*keys, F.explode(scores).alias("s")).select(*keys, "s.criterion", "s.e")


def recompute(doc_vectors: DataFrame, geometry: Geometry) -> DataFrame:
    """``(code_number, pdf_path, method, criterion, e)``, the greatest score over a paper's vectors."""
    keys = ["code_number", "pdf_path", "method"]
    return score_rows(doc_vectors, geometry, keys).groupBy(*keys, "criterion").agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("e"))


def score_controls(control_vectors: DataFrame, geometry: Geometry) -> DataFrame:
    """``(name, criterion, e)``."""
    return score_rows(control_vectors, geometry, ["name"])


def sweep(doc_vectors: DataFrame, pole_vectors: DataFrame, ks: list[int], strengths: list[float]) -> DataFrame:
    """Scores for each cell of a grid, with ``cell``, ``k`` and ``strength``.

    Mean and principal axes are fitted once, at the largest k (smaller ones are its beginnings); vectors are read once
    and a row's scores for all cells are an array.
    """
    mu, basis = principal_axes(representatives(doc_vectors), max(ks))
    poles = collect_poles(pole_vectors)
    axes = {s: build_axes(poles, mu, s)[0] for s in strengths}
    keys = ["code_number", "pdf_path", "method"]
    rows = doc_vectors.select(*keys, *[Geometry(mu, basis[:k], {}).project(F.col("vec")).alias(f"__k{i}") for i, k in enumerate(ks)])
    cells = []
    for i, k in enumerate(ks):
        for j, s in enumerate(strengths):
            for c, a in axes[s].items():
                cells.append(F.struct(F.lit(i * len(strengths) + j).alias("cell"), F.lit(k).alias("k"), F.lit(float(s)).alias("strength"), F.lit(c).alias("criterion"), V.dot(F.col(f"__k{i}"), V.literal(a)).alias("e")))
    long = rows.select(*keys, F.explode(F.array(*cells)).alias("s")).select(*keys, "s.*")
    return long.groupBy("cell", "k", "strength", *keys, "criterion").agg(F.max("e").alias("e"))


def pole_separation(pole_vectors: DataFrame) -> DataFrame:
    """``(pole, pair, cosine)``: like poles of each two criteria, and ``within`` for the two poles of each."""
    a, b = (pole_vectors.select(F.col("criterion").alias(f"c{i}"), F.col("pole").alias(f"p{i}"), F.col("vec").alias(f"v{i}")) for i in "12")
    across = a.join(b, (F.col("p1") == F.col("p2")) & (F.col("c1") < F.col("c2"))).select(F.col("p1").alias("pole"), F.concat_ws("~", "c1", "c2").alias("pair"), V.cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    inner = a.join(b, (F.col("c1") == F.col("c2")) & (F.col("p1") == "pos") & (F.col("p2") == "neg")).select(F.lit("within").alias("pole"), F.col("c1").alias("pair"), V.cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    return across.unionByName(inner)


def unit_mean(df: DataFrame, keys: list[str]) -> np.ndarray:
    """A4: unit mean over papers of their mean vectors; an error without papers."""
    per_paper = V.mean_vector(df, "vec", keys)
    rows = V.mean_vector(per_paper.withColumnRenamed("mean", "vec"), "vec", []).collect()
    if not rows or not rows[0]["mean"]:
        raise ValueError("no seed vectors for an anchor")
    return l2(np.array(rows[0]["mean"]))


def anchor(doc_vectors: DataFrame, seeds: DataFrame, geometry: Geometry, method: str = "chunk") -> np.ndarray:
    """A4: anchor of the projected vectors of the papers in ``seeds(pdf_path)``."""
    chosen = paper_vectors(doc_vectors.join(seeds.select("pdf_path").distinct(), "pdf_path", "left_semi"), method)
    return unit_mean(chosen.withColumn("vec", geometry.project(F.col("vec"))), ["pdf_path"])


def rank_papers(doc_vectors: DataFrame, geometry: Geometry, anchors: dict[str, np.ndarray], method: str = "chunk") -> DataFrame:
    """A5: ``(code_number, pdf_path, <anchor>..)``: greatest cosine of a paper's vectors with each anchor."""
    rows = paper_vectors(doc_vectors, method).select("code_number", "pdf_path", geometry.project(F.col("vec")).alias("d"))
    return rows.groupBy("code_number", "pdf_path").agg(*[F.max(V.dot(F.col("d"), V.literal(a))).alias(name) for name, a in anchors.items()])


def rank_codes(papers: DataFrame, names: DataFrame, score: str) -> DataFrame:
    """``(code_number, code_name, n_papers, mean, max)``, highest mean first, then lowest code."""
    out = papers.groupBy("code_number").agg(F.count(F.lit(1)).alias("n_papers"), F.avg(score).alias("mean"), F.max(score).alias("max"))
    return out.join(names, "code_number", "left").select("code_number", F.coalesce("code_name", F.lit("")).alias("code_name"), "n_papers", "mean", "max").orderBy(F.desc("mean"), "code_number")


def contrast_codes(papers: DataFrame, names: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of two anchors by code and their difference, highest first."""
    out = papers.groupBy("code_number").agg(F.count(F.lit(1)).alias("n_papers"), F.avg(first).alias("mean_first"), F.avg(second).alias("mean_second"))
    out = out.withColumn("mean_diff", F.col("mean_first") - F.col("mean_second")).join(names, "code_number", "left")
    return out.select("code_number", F.coalesce("code_name", F.lit("")).alias("code_name"), "n_papers", "mean_first", "mean_second", "mean_diff").orderBy(F.desc("mean_diff"), "code_number")


def rank_topics(centroids: DataFrame, geometry: Geometry, to: np.ndarray) -> DataFrame:
    """``(topic_id, label, cosine)`` of the projected centroids with an anchor, highest first."""
    return centroids.select("topic_id", "label", V.dot(geometry.project(F.col("vec")), V.literal(to)).alias("cosine")).orderBy(F.desc("cosine"), "topic_id")
