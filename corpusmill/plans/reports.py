"""Queries of validation and reports: scores met with verdicts, gold, citations and topics; geometry-space rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import corpus, geometry, gold, ranking, topics
from ..schemas import CRITERIA
from .base import PVEC, SIDES, UNIT, centroids, doc_vectors, pole_vectors, query, rounded, table

def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of ten codes, with a made-up score for each criterion and method."""
    each = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(m).alias("method"), F.lit(7 * i + 5 * j).alias("k")) for i, c in enumerate(CRITERIA) for j, m in enumerate(("full", "chunk"))])
    cells = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(each).alias("x"))
    e = ((F.col("n_chars") * 37 + F.col("doc_id") + F.col("x.k")) % 101) / 50 - 1
    return cells.select((F.col("doc_id") % 10).alias("code_number"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path"), "x.criterion", "x.method", e.alias("e"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts: quality for two criteria, toxicity for the third; every fifth is unclear."""
    named = lambda c, v: F.struct(F.lit(c).alias("criterion"), v.alias("verdict"))
    met = lambda x: F.when(F.col("doc_id") % 5 == 0, "unclear").when(x, "met").otherwise("not_met")
    each = F.explode(F.array(named(CRITERIA[0], met(F.col("quality") == 1)), named(CRITERIA[1], met(F.col("toxic") == 0)), named(CRITERIA[2], met(F.col("quality") == 0))))
    rows = table(spark, sf_dir, "labels").select("doc_id", each.alias("x"))
    return rows.select((F.col("doc_id") % 10).alias("code_number"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path"), "x.criterion", "x.verdict", F.lit(0.5).alias("confidence"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold rows: for all criteria, or for one."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path"), F.when((F.col("quality") + F.col("doc_id")) % 3 > 0, "pos").otherwise("neg").alias("polarity"), (F.col("doc_id") % 2 + 1).cast("string").alias("tier"), F.when(F.col("doc_id") % 4 == 0, "adaptors").otherwise("all").alias("criterion"))


_BASE = """cr(i, criterion) AS (VALUES (0, 'two_worlds'), (1, 'adaptors'), (2, 'arbitrariness')), me(j, method) AS (VALUES (0, 'full'), (1, 'chunk')),
sc AS (SELECT doc_id % 10 AS code_number, 'doc/' || doc_id AS pdf_path, criterion, method, ((n_chars * 37 + doc_id + 7 * i + 5 * j) % 101) / 50.0::DOUBLE - 1 AS e FROM documents, cr, me),
vd AS (SELECT doc_id % 10 AS code_number, 'doc/' || doc_id AS pdf_path, criterion, CASE WHEN doc_id % 5 = 0 THEN 'unclear' WHEN CASE i WHEN 0 THEN quality = 1 WHEN 1 THEN toxic = 0 ELSE quality = 0 END THEN 'met' ELSE 'not_met' END AS verdict, 0.5::DOUBLE AS confidence FROM labels, cr),
gd AS (SELECT 'doc/' || doc_id AS pdf_path, CASE WHEN (quality + doc_id) % 3 > 0 THEN 'pos' ELSE 'neg' END AS polarity, (doc_id % 2 + 1)::VARCHAR AS tier, CASE doc_id % 4 WHEN 0 THEN 'adaptors' ELSE 'all' END AS criterion FROM labels),
rp AS (SELECT sc.*, verdict, confidence FROM sc LEFT JOIN vd USING (code_number, pdf_path, criterion))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.report_rows(_scores(spark, sf_dir), _verdicts(spark, sf_dir))


@query("report_rows", f"WITH {_BASE} SELECT code_number, pdf_path, criterion, method, round(e, 5) + 0.0 AS e, verdict, confidence FROM rp")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).withColumn("e", rounded("e"))


@query("report_by_path", """WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, o_orderstatus FROM orders)
SELECT o_custkey::VARCHAR AS pdf_path, o_orderpriority AS criterion, min(o_orderkey) AS code_number, arg_max(o_totalprice, o_orderkey) AS e, arg_max(o_orderstatus, o_orderkey) AS verdict FROM r GROUP BY ALL""")
def report_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("code_number"), F.col("o_custkey").cast("string").alias("pdf_path"), F.lit("full").alias("method"), F.col("o_orderpriority").alias("criterion"), F.col("o_totalprice").alias("e"), F.col("o_orderstatus").alias("verdict"), F.lit(1.0).alias("confidence"))
    return ranking.by_path(rows).select("pdf_path", "criterion", "code_number", "e", "verdict")


_PAIRS = f"""{_BASE}, gx AS (SELECT pdf_path, polarity, tier, cr.criterion FROM gd JOIN cr ON gd.criterion = 'all' OR gd.criterion = cr.criterion),
pr AS (SELECT rp.*, polarity = 'pos' AS gold_pos, tier FROM rp JOIN gx USING (pdf_path, criterion) WHERE method = 'chunk')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gold_pairs(_report(spark, sf_dir).where("method = 'chunk'"), _gold(spark, sf_dir))


@query("gold_pairs", f"WITH {_PAIRS} SELECT pdf_path, criterion, round(e, 5) + 0.0 AS e, verdict, gold_pos, tier FROM pr")
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pdf_path", "criterion", rounded("e").alias("e"), "verdict", "gold_pos", "tier")


_RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


@query("gold_validation", f"""WITH {_PAIRS}, rk AS (SELECT criterion, gold_pos, {_RANKS.format(by="criterion", v="e")} AS rx, {_RANKS.format(by="criterion", v="gold_pos")} AS ry FROM pr),
a AS (SELECT criterion, count(*) FILTER (gold_pos) AS n_pos, count(*) FILTER (NOT gold_pos) AS n_neg, round((sum(rx) FILTER (gold_pos) - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 5) + 0.0 AS auc, round(corr(rx, ry), 5) + 0.0 AS rho FROM rk GROUP BY ALL),
c AS (SELECT criterion, count(*) FILTER (verdict = 'met' AND gold_pos) AS tp, count(*) FILTER (verdict = 'met' AND NOT gold_pos) AS fp, count(*) FILTER (verdict <> 'met' AND gold_pos) AS fn, count(*) FILTER (verdict <> 'met' AND NOT gold_pos) AS tn, count(verdict) AS n_judged FROM pr GROUP BY ALL)
SELECT criterion, n_pos, n_neg, auc, rho, tp, fp, fn, tn, n_judged, round(tp / (tp + fp)::DOUBLE, 5) AS precision, round(tp / (tp + fn)::DOUBLE, 5) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 5) AS f1 FROM a JOIN c USING (criterion)""")
def gold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.gold_validation(_pairs(spark, sf_dir))
    return out.withColumns({c: rounded(c) for c in ("auc", "rho", "precision", "recall", "f1")})


@query("gold_tiers", f"WITH {_PAIRS} SELECT criterion, tier, count(*) AS n, count(*) FILTER (gold_pos) AS n_pos, count(*) FILTER (NOT gold_pos) AS n_neg FROM pr GROUP BY ALL")
def gold_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.stats import tier_counts

    return tier_counts(_pairs(spark, sf_dir), ["criterion", "tier"], F.col("gold_pos"))


@query("pooled_rho", f"""WITH {_BASE}, j AS (SELECT criterion, method, e, CASE verdict WHEN 'met' THEN 1.0 WHEN 'unclear' THEN 0.5 ELSE 0.0 END AS o FROM rp WHERE verdict IS NOT NULL),
rk AS (SELECT criterion, method, {_RANKS.format(by="criterion, method", v="e")} AS rx, {_RANKS.format(by="criterion, method", v="o")} AS ry FROM j) SELECT criterion, method, count(*) AS n, round(corr(rx, ry), 5) + 0.0 AS rho FROM rk GROUP BY ALL""")
def pooled_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pooled_rho(_report(spark, sf_dir)).withColumn("rho", rounded("rho"))


@query("compared_verdicts", f"""WITH {_BASE}, b AS (SELECT criterion, 'old' AS side, verdict FROM vd UNION ALL SELECT criterion, 'new', CASE verdict WHEN 'unclear' THEN 'met' ELSE verdict END FROM vd)
SELECT criterion, side, count(*) FILTER (verdict = 'met') AS met, count(*) FILTER (verdict = 'not_met') AS not_met, count(*) FILTER (verdict = 'unclear') AS unclear FROM b GROUP BY ALL""")
def compared_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _verdicts(spark, sf_dir)
    return ranking.compared(old, old.withColumn("verdict", F.when(F.col("verdict") == "unclear", "met").otherwise(F.col("verdict"))))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranking_dataset(_scores(spark, sf_dir).where("method = 'full'"), _verdicts(spark, sf_dir))


_RECORDS = f"""{_BASE}, e AS (SELECT code_number, pdf_path, max(e) FILTER (criterion = 'two_worlds') AS e1, max(e) FILTER (criterion = 'adaptors') AS e2, max(e) FILTER (criterion = 'arbitrariness') AS e3 FROM sc WHERE method = 'full' GROUP BY ALL),
v AS (SELECT pdf_path, max(verdict) FILTER (criterion = 'two_worlds') AS v1, max(verdict) FILTER (criterion = 'adaptors') AS v2, max(verdict) FILTER (criterion = 'arbitrariness') AS v3 FROM vd GROUP BY ALL),
rc AS (SELECT * FROM e LEFT JOIN v USING (pdf_path))"""


@query("cited_records", f"WITH {_RECORDS}, c AS (SELECT c_custkey::VARCHAR AS b, c_name, c_mktsegment FROM customer) SELECT pdf_path, coalesce(c_mktsegment, '') AS code_name, coalesce(c_name, '') AS paper_name, c_name IS NOT NULL AS matched FROM rc LEFT JOIN c ON b = replace(pdf_path, 'doc/', '')")
def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("basename"), F.col("c_mktsegment").alias("code_name"), F.col("c_name").alias("paper_name"))
    return ranking.with_citations(_records(spark, sf_dir), known).select("pdf_path", "code_name", "paper_name", "matched")


_TOPICS = "t AS (SELECT 'doc/' || conv_id AS pdf_path, array_agg(DISTINCT role ORDER BY role) AS topics FROM conversations GROUP BY ALL)"


def _with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("doc/"), F.col("conv_id").cast("string")).alias("pdf_path")).agg(F.array_sort(F.collect_set("role")).alias("topics"))
    return ranking.with_topics(_records(spark, sf_dir), known)


@query("records_with_topics", f"WITH {_RECORDS}, {_TOPICS} SELECT pdf_path, coalesce(array_to_string(topics, '; '), '') AS topics FROM rc LEFT JOIN t USING (pdf_path)")
def records_with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_topics(spark, sf_dir).select("pdf_path", F.array_join("topics", "; ").alias("topics"))


@query("labelled_counts", f"WITH {_RECORDS}, {_TOPICS} SELECT count(*) AS papers, count(*) FILTER (v1 IS NOT NULL OR v2 IS NOT NULL OR v3 IS NOT NULL) AS judged, count(*) FILTER (len(topics) > 0) AS with_topics FROM rc LEFT JOIN t USING (pdf_path)")
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.labelled_counts(_with_topics(spark, sf_dir))


@query("matching_records", f"WITH {_RECORDS}, {_TOPICS} SELECT pdf_path FROM rc LEFT JOIN t USING (pdf_path) WHERE contains(lower('Name ' || pdf_path || ' ' || code_number || ' ' || coalesce(array_to_string(topics, ' '), '')), 'c/7') OR contains(coalesce(array_to_string(topics, ' '), ''), 'c/7')")
def matching_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_topics(spark, sf_dir).withColumn("code_name", F.lit("Name")).withColumn("paper_name", F.col("pdf_path"))
    return ranking.matching(rows, "C/7").select("pdf_path")


@query("ranked_records", f"WITH {_RECORDS}, m AS (SELECT code_number, pdf_path, list_median(list_filter([e1, e2, e3], lambda x: x IS NOT NULL)) AS value FROM rc) SELECT code_number, pdf_path, round(value, 5) + 0.0 AS value, row_number() OVER (PARTITION BY code_number ORDER BY round(value, 9) DESC NULLS LAST, pdf_path)::INT AS rank FROM m")
def ranked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    rows = rows.withColumns({f"e_{c}": F.round(f"e_{c}", 9) for c in CRITERIA})
    return ranking.ranked(rows, "e", "median", ["code_number"]).select("code_number", "pdf_path", rounded("value").alias("value"), "rank")


@query("ranked_by_verdict", f"""WITH {_RECORDS}, m AS (SELECT code_number, pdf_path, list_transform(list_filter([v1, v2, v3], lambda x: x IS NOT NULL), lambda x: CASE x WHEN 'met' THEN 1.0 WHEN 'unclear' THEN 0.5 ELSE 0.0 END) AS o FROM rc)
SELECT code_number, pdf_path, CASE WHEN len(o) > 0 THEN list_min(o) END::DOUBLE AS value FROM m""")
def ranked_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_records(spark, sf_dir), "o", "min").select("code_number", "pdf_path", "value")


@query("signed_numbers", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE printf('%+.3f', value - 50) END AS shown FROM events")
def signed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_type") != "error", F.col("value") - 50)
    return table(spark, sf_dir, "events").select("event_id", X.signed_number(x).alias("shown"))


# Selection of papers


@query("gold_by_polarity", f"WITH {_BASE} SELECT pdf_path, tier, criterion FROM gd WHERE polarity = 'neg'")
def gold_by_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.of_polarity(_gold(spark, sf_dir), "neg").select("pdf_path", "tier", "criterion")


@query("negatives_without_conflicts", f"WITH {_BASE} SELECT DISTINCT pdf_path FROM vd WHERE pdf_path NOT IN (SELECT pdf_path FROM gd WHERE polarity = 'pos')")
def negatives_without_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir).select("code_number", "pdf_path", *[F.lit("x").alias(c) for c in ("polarity", "tier", "source", "criterion", "evidence")]).distinct()
    return gold.without_conflicts(rows, _gold(spark, sf_dir)).select("pdf_path")


@query("anchor_papers", "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE regexp_matches(n_name, '[13]')")
def anchor_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("code_number"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code_number"), F.regexp_replace("n_name", "[13]", "Genetic  CODE ").alias("code_name"))
    return gold.anchor_papers(c, names).select("c_custkey", "c_name")


@query("corpus_pool", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL")
def corpus_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations whose paper is on disk, the first of each path."""
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pdf_path"), F.col("o_orderkey").alias("position"))
    files = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("pdf_path"))
    return corpus.pool(cited, files).select(F.col("pdf_path").alias("o_custkey"), F.col("position").alias("first_order"))


@query("found_papers", "SELECT doc_id, true AS found FROM documents WHERE doc_id IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, false FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)")
def found_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_path"))
    found, missing = corpus.found_and_missing(papers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pdf_path")))
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False))).withColumnRenamed("pdf_path", "doc_id")


@query("selected_papers", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY vec_id LIMIT 25")
def selected_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first n of the wanted papers with a dominant topic."""
    dominants = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pdf_path"), F.col("label").alias("topic_id"))
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("pdf_path"))
    return corpus.selected(dominants, wanted, 25).select(F.col("pdf_path").alias("vec_id"), F.col("topic_id").alias("label"))


@query("self_references", "SELECT page_id, contains(lower(url), '/fr/') AS dropped FROM pages")
def self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are kept, and those of the corpus's own pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("pdf_path"))
    own = X.self_reference(F.col("pdf_path"), ["/FR/"])
    kept, dropped = corpus.without_self_references(pages, own)
    gone = pages.join(dropped, "pdf_path", "left_semi").select("page_id", F.lit(True).alias("dropped"))
    return kept.select("page_id", F.lit(False).alias("dropped")).unionByName(gone)


@query("seminal_files", "SELECT p_name AS name, min(p_partkey) AS position FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45) GROUP BY ALL")
def seminal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed name once, in its first place, if it is on disk."""
    part = table(spark, sf_dir, "part")
    listed = part.select(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("source_file"), F.col("p_partkey").alias("position"))
    return corpus.seminal_files(listed, ["absent.pdf"], part.where("p_size > 45").select(F.col("p_name").alias("basename"))).select("name", "position")


@query("rows_to_append", "SELECT min(p_partkey) AS position, p_name AS paper_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 7) GROUP BY p_name")
def rows_to_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by link, or by name without one, that code 0 does not have."""
    part = table(spark, sf_dir, "part")
    manifest = part.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("paper_name"), F.lit(" ").alias("url"))
    existing = part.select(F.when(F.col("p_size") == 7, 0).otherwise(1).alias("code_number"), F.col("p_name").alias("paper_name"), F.lit("").alias("url"))
    return corpus.rows_to_append(manifest, existing).select("position", "paper_name")


@query("missing_files", "SELECT DISTINCT p_name AS source_file FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 7)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return corpus.missing_files(part.select(F.col("p_name").alias("source_file")), part.where("p_size = 7").select(F.col("p_name").alias("basename")))


# Geometry space: centred by the papers' first vectors, nothing removed, strength 0

_CENTRED = f"""{UNIT}, mu AS (SELECT i, avg(x) AS m FROM u WHERE vec_id % 5 = 0 GROUP BY i), cv AS (SELECT vec_id, i, x - m AS x FROM u JOIN mu USING (i)),
vn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM cv GROUP BY ALL), pj AS (SELECT vec_id, i, x / n AS x FROM cv JOIN vn USING (vec_id)),
ce AS (SELECT label AS topic_id, i, avg(x) AS c FROM u GROUP BY ALL), cc AS (SELECT topic_id, i, c - m AS c FROM ce JOIN mu USING (i)),
cn AS (SELECT topic_id, greatest(sqrt(sum(c * c)), 1e-12) AS n FROM cc GROUP BY ALL), pc AS (SELECT topic_id, i, c / n AS c FROM cc JOIN cn USING (topic_id)),
sd AS (SELECT DISTINCT vec_id // 5 AS p FROM embeddings WHERE label = 0), ap AS (SELECT vec_id // 5 AS p, i, avg(x) AS x FROM pj WHERE vec_id // 5 IN (FROM sd) GROUP BY ALL),
am AS (SELECT i, avg(x) AS x FROM ap GROUP BY i), an AS (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM am) AS a FROM am)"""


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, geometry.Geometry]:
    docs = doc_vectors(spark, sf_dir)
    return docs, geometry.fit(docs, pole_vectors(spark, sf_dir), 0, 0.0)


@query("geometry_topics", f"""WITH {_CENTRED}, sim AS (SELECT vec_id, topic_id, sum(x * c) AS s FROM pj JOIN pc USING (i) GROUP BY ALL)
SELECT 'paper/' || (vec_id // 5) AS pdf_path, (vec_id % 5)::INT AS chunk_idx, topic_id, round(s, 5) + 0.0 AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1""")
def geometry_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of chunks in the papers' geometry."""
    docs, fitted = _fitted(spark, sf_dir)
    return topics.assign(docs, centroids(spark, sf_dir), fitted).select("pdf_path", "chunk_idx", "topic_id", rounded("similarity").alias("similarity"))


@query("geometry_paper_ranking", f"WITH {_CENTRED} SELECT ((vec_id // 5) % 10)::INT AS code_number, 'paper/' || (vec_id // 5) AS pdf_path, round(max(s), 5) + 0.0 AS molecular FROM (SELECT vec_id, sum(x * a) AS s FROM pj JOIN an USING (i) GROUP BY ALL) GROUP BY ALL")
def geometry_paper_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: papers by their nearest vector to the anchor of some papers."""
    docs, fitted = _fitted(spark, sf_dir)
    anchor = geometry.anchor(docs, docs.where("label = 0"), fitted)
    return geometry.rank_papers(docs, fitted, {"molecular": anchor}).withColumn("molecular", rounded("molecular"))


@query("geometry_topic_ranking", f"WITH {_CENTRED} SELECT topic_id, 'label ' || topic_id AS label, round(sum(c * a), 5) + 0.0 AS cosine FROM pc JOIN an USING (i) GROUP BY ALL")
def geometry_topic_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by the cosine of their projected centroids with the anchor."""
    docs, fitted = _fitted(spark, sf_dir)
    anchor = geometry.anchor(docs, docs.where("label = 0"), fitted)
    return geometry.rank_topics(centroids(spark, sf_dir), fitted, anchor).withColumn("cosine", rounded("cosine"))


@query("paper_vectors", """WITH d AS (SELECT vec_id // 5 AS p, CASE WHEN vec_id % 5 = 0 THEN 'full' WHEN label < 5 THEN 'chunk' ELSE 'abstract' END AS method, vec_id FROM embeddings),
b AS (SELECT p, min(CASE method WHEN 'chunk' THEN 0 WHEN 'full' THEN 1 ELSE 2 END) AS best FROM d GROUP BY p) SELECT vec_id FROM d JOIN b USING (p) WHERE CASE method WHEN 'chunk' THEN 0 WHEN 'full' THEN 1 ELSE 2 END = best""")
def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted method's vectors of a paper, else the full text's."""
    method = F.when(F.col("chunk_idx") == 0, "full").when(F.col("label") < 5, "chunk").otherwise("abstract")
    return geometry.paper_vectors(doc_vectors(spark, sf_dir).withColumn("method", method)).select("vec_id")


@query("method_order", "SELECT event_type AS method FROM events GROUP BY 1")
def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.method_order(table(spark, sf_dir, "events").select(F.col("event_type").alias("method")))


@query("scored_again", f"""WITH {_CENTRED}, {SIDES}, {PVEC}, cp AS (SELECT criterion, pole, i, x - m AS x FROM pv JOIN mu USING (i)), qn AS (SELECT criterion, pole, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM cp GROUP BY ALL)
SELECT criterion, round(sum(a.x / qa.n * b.x / qb.n), 5) + 0.0 AS within FROM cp a JOIN cp b USING (criterion, i) JOIN qn qa USING (criterion) JOIN qn qb USING (criterion) WHERE a.pole = 'pos' AND b.pole = 'neg' AND qa.pole = 'pos' AND qb.pole = 'neg' GROUP BY criterion""")
def scored_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine between the centred poles of each criterion, as a fit gives it."""
    _, fitted = _fitted(spark, sf_dir)
    return spark.createDataFrame(sorted(fitted.within.items()), "criterion string, within double").withColumn("within", rounded("within"))


@query("packed_vectors", "SELECT vec_id, octet_length(''::BLOB) + 4 * len(embedding) AS bytes, true AS same FROM embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back."""
    packed = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.pack("embedding").alias("b"))
    return packed.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (V.unpack("b") == F.col("embedding")).alias("same"))


# What SQL itself offers beyond the inventory's operators


@query("as_of_join", "SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts GROUP BY ALL")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of a user at or before each event: a running maximum, no join."""
    from ..operators.ranking import as_of

    e = table(spark, sf_dir, "events")
    return as_of(e, ["user_id"], "ts", F.when(F.col("event_type") == "purchase", F.col("ts")), "last_purchase").select("event_id", "last_purchase")


@query("full_outer", "SELECT coalesce(d.doc_id, c.c_custkey) AS id, d.lang, c.c_mktsegment FROM documents d FULL OUTER JOIN customer c ON d.doc_id = c.c_custkey + 100")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("doc_id"), "c_custkey", "c_mktsegment", F.lit(True).alias("there"))
    both = d.withColumn("here", F.lit(True)).join(c, "doc_id", "full_outer")
    return both.select(F.when(F.col("here"), F.col("doc_id")).otherwise(F.col("c_custkey")).alias("id"), "lang", "c_mktsegment")


@query("distribution_windows", """SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 5) + 0.0 AS percent_rank, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 5) + 0.0 AS cume_dist, lag(o_orderkey) OVER w AS earlier FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def distribution_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each customer's few orders."""
    from pyspark.sql import Window

    by_price = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    order = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(order).alias("quarter"), rounded(F.percent_rank().over(by_price)).alias("percent_rank"), rounded(F.cume_dist().over(by_price)).alias("cume_dist"), F.lag("o_orderkey").over(order).alias("earlier"))


@query("set_operations", "(SELECT o_custkey AS id, 'both' AS kind FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL (SELECT c_custkey, 'idle' FROM customer EXCEPT SELECT o_custkey, 'idle' FROM orders)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    both = o.intersect(c.where("c_mktsegment = 'BUILDING'").select("id")).withColumn("kind", F.lit("both"))
    return both.unionByName(c.select("id").subtract(o).withColumn("kind", F.lit("idle")))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 5")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of two keys and their totals, the small ones left out."""
    out = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.where("n > 5")
