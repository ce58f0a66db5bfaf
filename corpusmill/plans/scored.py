"""Queries of the embedding axis: vectors, geometry, topics, rankings, correlation with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import vectors as V
from ..operators import geometry, gold, ranking, topics
from .base import AXIS, POLES, PVEC, SIDES, UNIT, centroids, doc_vectors, pole_vectors, query, rounded, table


def _axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all vectors on the axes of the uncentred poles."""
    poles = geometry.collect_poles(pole_vectors(spark, sf_dir))
    axes = {c: geometry.l2(geometry.l2(p["pos"]) - geometry.l2(p["neg"])) for c, p in poles.items()}
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("d"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), V.dot(F.col("d"), V.literal(a)).alias("e")) for c, a in axes.items()]))
    return rows.select("vec_id", "label", each.alias("s")).select("vec_id", "label", "s.*")


_SCORES = f"WITH {UNIT}, {SIDES}, {PVEC}, {AXIS}, sc AS (SELECT vec_id, label, criterion, sum(x * a) AS e FROM un JOIN ax USING (i) GROUP BY ALL)"


@query("vector_norms", f"WITH {UNIT} SELECT vec_id, round(n, 5) + 0.0 AS norm, round(sum(x * x), 5) + 0.0 AS unit_square FROM un JOIN nn USING (vec_id) GROUP BY vec_id, n")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "embeddings").select("vec_id", V.norm(F.col("embedding")).alias("n"), V.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", rounded("n").alias("norm"), rounded(V.dot(F.col("u"), F.col("u"))).alias("unit_square"))


@query("corpus_mean_vector", "WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i::INT AS i, round(avg(x), 5) + 0.0 AS mean FROM u GROUP BY ALL")
def corpus_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return means.select("label", F.posexplode("mean").alias("i", "mean")).select("label", "i", rounded("mean").alias("mean"))


@query("pole_axis_score", f"{_SCORES} SELECT vec_id, criterion, round(e, 5) + 0.0 AS e FROM sc")
def pole_axis_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _axis_scores(spark, sf_dir).select("vec_id", "criterion", rounded("e").alias("e"))


@query("contrastive_score", f"WITH {UNIT}, {SIDES}, {PVEC} SELECT vec_id, criterion, round(sum(CASE pole WHEN 'pos' THEN un.x * pv.x ELSE -un.x * pv.x END), 5) + 0.0 AS e FROM un JOIN pv USING (i) GROUP BY vec_id, criterion")
def contrastive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    poles = geometry.collect_poles(pole_vectors(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), V.contrast(F.col("embedding"), V.literal(p["pos"]), V.literal(p["neg"])).alias("e")) for c, p in poles.items()]))
    return table(spark, sf_dir, "embeddings").select("vec_id", each.alias("s")).select("vec_id", "s.criterion", rounded("s.e").alias("e"))


@query(
    "levered_score_k0",
    f"""WITH {UNIT}, {SIDES}, {PVEC}, mu AS (SELECT i, avg(x) AS m FROM u WHERE vec_id % 5 = 0 GROUP BY i),
cp AS (SELECT criterion, pole, i, x - m AS x FROM pv JOIN mu USING (i)), cn AS (SELECT criterion, pole, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM cp GROUP BY ALL),
dv AS (SELECT criterion, i, sum(CASE pole WHEN 'pos' THEN x / n ELSE -x / n END) AS x FROM cp JOIN cn USING (criterion, pole) GROUP BY ALL),
dn AS (SELECT criterion, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM dv GROUP BY ALL), ax AS (SELECT criterion, i, x / n AS a FROM dv JOIN dn USING (criterion)),
cv AS (SELECT vec_id, i, x - m AS x FROM u JOIN mu USING (i)), vn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM cv GROUP BY ALL),
sc AS (SELECT vec_id, criterion, sum(x / n * a) AS e FROM cv JOIN vn USING (vec_id) JOIN ax USING (i) GROUP BY ALL)
SELECT ((vec_id // 5) % 10)::INT AS code_number, 'paper/' || (vec_id // 5) AS pdf_path, 'chunk' AS method, criterion, round(max(e), 5) + 0.0 AS e FROM sc GROUP BY ALL""",
)
def levered_score_k0(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_vectors(spark, sf_dir)
    fitted = geometry.fit(docs, pole_vectors(spark, sf_dir), k=0, strength=0.0)
    return geometry.recompute(docs, fitted).withColumn("e", rounded("e"))


@query("whitened_score_k2")
def whitened_score_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_vectors(spark, sf_dir)
    return geometry.recompute(docs, geometry.fit(docs, pole_vectors(spark, sf_dir), k=2, strength=0.5)).withColumn("e", rounded("e"))


@query("control_scores")
def control_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_vectors(spark, sf_dir)
    controls = centroids(spark, sf_dir).select(F.col("label").alias("name"), "vec")
    return geometry.score_controls(controls, geometry.fit(docs, pole_vectors(spark, sf_dir), k=2)).withColumn("e", rounded("e"))


@query(
    "pole_separation",
    f"""WITH {UNIT}, {SIDES}, {PVEC}, dots AS (SELECT a.criterion AS c1, a.pole AS p1, b.criterion AS c2, b.pole AS p2, sum(a.x * b.x) AS d FROM pv a JOIN pv b USING (i) GROUP BY ALL)
SELECT p1 AS pole, c1 || '~' || c2 AS pair, round(d, 5) + 0.0 AS cosine FROM dots WHERE p1 = p2 AND c1 < c2
UNION ALL SELECT 'within', c1, round(d, 5) + 0.0 FROM dots WHERE c1 = c2 AND p1 = 'pos' AND p2 = 'neg'""",
)
def pole_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pole_separation(pole_vectors(spark, sf_dir)).withColumn("cosine", rounded("cosine"))


_NEAREST = """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
ce AS (SELECT label AS topic_id, i, avg(x) AS c FROM u GROUP BY ALL), sim AS (SELECT vec_id, topic_id, sum(x * c) AS s FROM u JOIN ce USING (i) GROUP BY ALL),
nearest AS (SELECT vec_id, topic_id, s FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1)"""


def _chunk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = topics.collected(centroids(spark, sf_dir))
    d = doc_vectors(spark, sf_dir)
    return d.select("vec_id", "code_number", "pdf_path", "chunk_idx", topics.nearest(F.col("vec"), choices).alias("n")).select("vec_id", "code_number", "pdf_path", "chunk_idx", "n.topic_id", "n.similarity")


@query("nearest_centroid", f"{_NEAREST} SELECT vec_id, topic_id, round(s, 5) + 0.0 AS similarity FROM nearest")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_topics(spark, sf_dir).select("vec_id", "topic_id", rounded("similarity").alias("similarity"))


@query("nearest_centroid_join", f"{_NEAREST} SELECT vec_id, topic_id, round(s, 5) + 0.0 AS similarity FROM nearest")
def nearest_centroid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return topics.nearest_by_join(rows, centroids(spark, sf_dir), ["vec_id"]).withColumn("similarity", rounded("similarity"))


_AFFINITY = f"""{_NEAREST}, af AS (SELECT 'paper/' || (vec_id // 5) AS pdf_path, topic_id, max(s) AS affinity, min(vec_id % 5) AS f, count(*) AS n FROM nearest GROUP BY ALL),
dom AS (SELECT * FROM af QUALIFY row_number() OVER (PARTITION BY pdf_path ORDER BY affinity DESC, f) = 1)"""


@query("dominant_topic", f"{_AFFINITY} SELECT pdf_path, topic_id, round(affinity, 5) + 0.0 AS affinity FROM dom")
def dominant_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.dominant(_chunk_topics(spark, sf_dir), ["pdf_path"]).withColumn("affinity", rounded("affinity"))


@query("paper_topics", f"{_AFFINITY} SELECT af.pdf_path, string_agg('label ' || af.topic_id, '; ' ORDER BY af.topic_id <> dom.topic_id, af.n DESC, af.affinity DESC, af.topic_id) AS topics FROM af JOIN dom USING (pdf_path) GROUP BY af.pdf_path")
def paper_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = centroids(spark, sf_dir).select("topic_id", "label")
    return topics.paper_topics(_chunk_topics(spark, sf_dir), labels, ["pdf_path"]).select("pdf_path", F.array_join("topics", "; ").alias("topics"))


@query("top_strata", f"{_AFFINITY}, top AS (SELECT topic_id FROM dom GROUP BY 1 ORDER BY count(*) DESC, topic_id LIMIT 3) SELECT pdf_path, topic_id FROM dom WHERE topic_id IN (FROM top)")
def top_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.in_strata(topics.dominant(_chunk_topics(spark, sf_dir), ["pdf_path"]), 3).select("pdf_path", "topic_id")


@query("rest_strata", f"{_AFFINITY}, top AS (SELECT topic_id FROM dom GROUP BY 1 ORDER BY count(*) DESC, topic_id LIMIT 3) SELECT pdf_path, topic_id FROM dom WHERE topic_id NOT IN (FROM top)")
def rest_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.in_strata(topics.dominant(_chunk_topics(spark, sf_dir), ["pdf_path"]), 3, rest=True).select("pdf_path", "topic_id")


@query("topic_frequency", f"{_AFFINITY} SELECT topic_id, count(*) AS n_papers FROM dom GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def topic_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.top_topics(topics.dominant(_chunk_topics(spark, sf_dir), ["pdf_path"]), 4)


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest cosine of each paper's vectors with the unit means of labels 0 and 1."""
    e = doc_vectors(spark, sf_dir)
    anchors = {n: geometry.unit_mean(e.where(F.col("label") == i).withColumn("vec", V.unit(F.col("vec"))), ["pdf_path"]) for n, i in (("first", 0), ("second", 1))}
    rows = e.select("code_number", "pdf_path", V.unit(F.col("vec")).alias("d"))
    return rows.groupBy("code_number", "pdf_path").agg(*[F.max(V.dot(F.col("d"), V.literal(a))).alias(n) for n, a in anchors.items()])


_ANCHORED = f"""WITH {UNIT}, pp AS (SELECT vec_id // 5 AS p, label, i, avg(x) AS x FROM un WHERE label IN (0, 1) GROUP BY ALL), am AS (SELECT label, i, avg(x) AS x FROM pp GROUP BY ALL),
an AS (SELECT label, sqrt(sum(x * x)) AS n FROM am GROUP BY ALL), anchor AS (SELECT label AS l, i, x / n AS a FROM am JOIN an USING (label)),
d AS (SELECT vec_id, l, sum(x * a) AS s FROM un JOIN anchor USING (i) GROUP BY ALL),
pm AS (SELECT vec_id // 5 AS p, max(s) FILTER (l = 0) AS f, max(s) FILTER (l = 1) AS g FROM d GROUP BY ALL)"""


@query("code_ranking", f"{_ANCHORED} SELECT (p % 10)::INT AS code_number, 'code ' || (p % 10) AS code_name, count(*) AS n_papers, round(avg(f), 5) + 0.0 AS mean, round(max(f), 5) + 0.0 AS max FROM pm GROUP BY ALL")
def code_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(10).select(F.col("id").cast("int").alias("code_number"), F.concat(F.lit("code "), F.col("id").cast("string")).alias("code_name"))
    return geometry.rank_codes(_anchored(spark, sf_dir), names, "first").withColumns({"mean": rounded("mean"), "max": rounded("max")})


@query("anchor_contrast", f"{_ANCHORED} SELECT (p % 10)::INT AS code_number, count(*) AS n_papers, round(avg(f), 5) + 0.0 AS mean_first, round(avg(g), 5) + 0.0 AS mean_second, round(avg(f) - avg(g), 5) + 0.0 AS mean_diff FROM pm GROUP BY ALL")
def anchor_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(10).select(F.col("id").cast("int").alias("code_number"), F.lit("").alias("code_name"))
    out = geometry.contrast_codes(_anchored(spark, sf_dir), names, "first", "second").drop("code_name")
    return out.withColumns({c: rounded(c) for c in ("mean_first", "mean_second", "mean_diff")})


@query("topic_ranking", f"{_ANCHORED}, u2 AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), n2 AS (SELECT label, sqrt(sum(x * x)) AS n FROM u2 GROUP BY ALL) SELECT u2.label AS topic_id, round(sum(x / n * a), 5) + 0.0 AS cosine FROM u2 JOIN n2 ON n2.label = u2.label JOIN anchor ON anchor.i = u2.i AND l = 0 GROUP BY ALL")
def topic_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = doc_vectors(spark, sf_dir)
    anchor = geometry.unit_mean(e.where("label = 0").withColumn("vec", V.unit(F.col("vec"))), ["pdf_path"])
    return centroids(spark, sf_dir).select("topic_id", rounded(V.dot(V.unit(F.col("vec")), V.literal(anchor))).alias("cosine"))


def _labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    return _axis_scores(spark, sf_dir).join(labels, "vec_id")


@query(
    "auc_quality",
    f"""{_SCORES}, j AS (SELECT criterion, e, quality = 1 AS p FROM sc JOIN labels ON doc_id = vec_id),
pairs AS (SELECT a.criterion, CASE WHEN a.e > b.e THEN 1.0 WHEN a.e = b.e THEN 0.5 ELSE 0.0 END AS w FROM j a JOIN j b ON a.criterion = b.criterion AND a.p AND NOT b.p)
SELECT criterion, (SELECT count(*) FROM j WHERE p AND j.criterion = pairs.criterion) AS n_pos, (SELECT count(*) FROM j WHERE NOT p AND j.criterion = pairs.criterion) AS n_neg, round(avg(w), 5) + 0.0 AS auc FROM pairs GROUP BY criterion""",
)
def auc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_scores(spark, sf_dir).withColumn("positive", F.col("quality") == 1)
    return stats.auc(rows, "e", "positive", ["criterion"]).withColumn("auc", rounded("auc"))


_RHO = "rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM j)"


@query(
    "spearman_by_group",
    f"""{_SCORES}, j AS (SELECT label, criterion, e AS x, (quality + 2 * toxic)::DOUBLE AS y FROM sc JOIN labels ON doc_id = vec_id), {_RHO.format(by="label, criterion")}
SELECT label, criterion, count(*) AS n, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN round(corr(rx, ry), 5) + 0.0 END AS rho FROM rk GROUP BY ALL""",
)
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_scores(spark, sf_dir).withColumn("y", (F.col("quality") + 2 * F.col("toxic")).cast("double"))
    return stats.spearman(rows, "e", "y", ["label", "criterion"]).withColumn("rho", rounded("rho"))


@query(
    "topic_strata_rho",
    f"""{_SCORES}, sz AS (SELECT label, count(DISTINCT vec_id) AS n_papers FROM sc JOIN labels ON doc_id = vec_id GROUP BY 1 HAVING count(DISTINCT vec_id) >= 10),
j AS (SELECT label AS topic_id, n_papers, criterion, e AS x, CASE quality WHEN 1 THEN 1.0 ELSE 0.0 END AS y FROM sc JOIN labels ON doc_id = vec_id JOIN sz USING (label)), {_RHO.format(by="topic_id, criterion")}
SELECT topic_id, n_papers, criterion, 'full' AS method, count(*) AS n, CASE WHEN count(DISTINCT ry) > 1 AND count(DISTINCT rx) > 1 THEN round(corr(rx, ry), 5) + 0.0 END AS rho FROM rk GROUP BY ALL""",
)
def topic_strata_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_scores(spark, sf_dir).withColumn("pdf_path", F.col("vec_id").cast("string"))
    report = rows.select("pdf_path", "criterion", "e", F.lit("full").alias("method"), F.when(F.col("quality") == 1, "met").otherwise("not_met").alias("verdict"))
    dominants = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pdf_path"), F.col("label").alias("topic_id"))
    return ranking.topic_rho(report, dominants).withColumn("rho", rounded("rho"))


@query("sweep_grid")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = geometry.sweep(doc_vectors(spark, sf_dir), pole_vectors(spark, sf_dir), [0, 1, 2], [0.0, 0.5, 1.0])
    return swept.groupBy("cell", "k", "strength", "criterion").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("e")).alias("mean_e"))


@query("sweep_best_cell")
def sweep_best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy(F.concat(F.lit("paper/"), F.floor(F.col("doc_id") / 5).cast("string")).alias("pdf_path")).agg(F.min("quality").alias("q"))
    verdicts = docs.select("code_number", "pdf_path").distinct().join(labels, "pdf_path").select("code_number", "pdf_path", F.explode(F.array(*[F.lit(c) for c in POLES])).alias("criterion"), F.when(F.col("q") == 1, "met").otherwise("not_met").alias("verdict"))
    grid = ranking.grid_rho(geometry.sweep(docs, pole_vectors(spark, sf_dir), [0, 2], [0.0, 0.5]), verdicts, "chunk")
    return ranking.best_cells(grid).withColumn("rho", rounded("rho"))


_CODES = """pap AS (SELECT ((vec_id // 5) % 10)::INT AS code_number, 'paper/' || (vec_id // 5) AS pdf_path FROM embeddings GROUP BY ALL),
cnt AS (SELECT code_number, topic_id, count(*) AS n FROM pap JOIN dom USING (pdf_path) WHERE code_number <> 0 GROUP BY ALL),
modal AS (SELECT code_number, topic_id FROM cnt QUALIFY row_number() OVER (PARTITION BY code_number ORDER BY n DESC, topic_id) = 1),
mol AS (SELECT * FROM modal WHERE topic_id % 2 = 0)"""


def _gold_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    dominants = topics.dominant(_chunk_topics(spark, sf_dir), ["pdf_path"])
    labels = centroids(spark, sf_dir).select("topic_id", "label")
    return doc_vectors(spark, sf_dir).select("code_number", "pdf_path").distinct(), dominants, labels.where("topic_id % 2 = 0"), labels


@query("molecular_codes", f"{_AFFINITY}, {_CODES} SELECT code_number, topic_id, (SELECT count(*) FROM pap WHERE pap.code_number = mol.code_number) AS n_papers FROM mol")
def molecular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, dominants, allowed, _ = _gold_inputs(spark, sf_dir)
    return gold.molecular_codes(papers, dominants, allowed)


@query(
    "gold_selection",
    f"""{_AFFINITY}, {_CODES} SELECT code_number, pdf_path, 'pos' AS polarity, '2' AS tier, 'db' AS source, 'all' AS criterion FROM pap JOIN mol USING (code_number)
UNION ALL SELECT code_number, pdf_path, 'pos', '1', 'code0', 'all' FROM pap WHERE code_number = 0""",
)
def gold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, dominants, allowed, labels = _gold_inputs(spark, sf_dir)
    names = papers.select("code_number", F.lit("code").alias("code_name")).distinct()
    empty = spark.createDataFrame([], "code_number int, pdf_path string, polarity string, tier string, source string, criterion string, evidence string")
    return gold.select_phase(empty, papers, dominants, allowed, names, labels).drop("evidence")


@query("implicit_negatives", f"{_AFFINITY}, {_CODES} SELECT code_number, pdf_path, 'soft' AS tier, 'non-molecular: topic ' || topic_id || ' label ' || topic_id AS evidence FROM pap JOIN dom USING (pdf_path) WHERE code_number <> 0 AND code_number NOT IN (SELECT code_number FROM mol) AND topic_id % 2 <> 0")
def implicit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, dominants, allowed, labels = _gold_inputs(spark, sf_dir)
    molecular = gold.molecular_codes(papers, dominants, allowed)
    return gold.implicit_negatives(papers, dominants, allowed, molecular, labels, papers.limit(0)).select("code_number", "pdf_path", "tier", "evidence")
