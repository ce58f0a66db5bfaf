"""Queries of the judge axis and the store, with events, orders and labels in the place of judged chunks and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import corpus, judging, ranking, topics
from ..sources import store
from ..streaming import ingest as streams
from .base import GRADED, graded_chunks, query, rounded, table, working_folder


@query("graded_rollup", f"""WITH {GRADED}, t AS (SELECT *, row_number() OVER (PARTITION BY code_number, pdf_path, criterion ORDER BY agreement DESC, chunk_idx) AS r FROM g)
SELECT code_number, pdf_path, criterion, max(agreement) AS graded_max, round(avg(agreement), 5) + 0.0 AS graded_mean, round(max(confidence) FILTER (r = 1), 5) + 0.0 AS confidence,
CASE WHEN max(agreement) >= 0.5 THEN 'met' WHEN max(agreement) <= 0 THEN 'not_met' ELSE 'unclear' END AS verdict, count(*) AS n_chunks FROM t GROUP BY ALL""")
def graded_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judging.graded_rollup(graded_chunks(spark, sf_dir), ["code_number", "pdf_path", "criterion"])
    return out.withColumns({"graded_mean": rounded("graded_mean"), "confidence": rounded("confidence")})


@query("newest_judge_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def newest_judge_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judging.newest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [judging.descending(F.col("ts")), -F.col("event_id")])
    return rows.select("user_id", "event_type", "event_id", "value")


@query("code_support", f"""WITH {GRADED}, v AS (SELECT code_number, pdf_path, criterion, max(agreement) >= 0.5 AS met FROM g GROUP BY ALL),
p AS (SELECT code_number, pdf_path, count(*) FILTER (met AND criterion IN ('view','click','purchase')) = 3 AS q FROM v GROUP BY ALL)
SELECT code_number, count(*) AS total, count(*) FILTER (q) AS supported FROM p GROUP BY ALL""")
def code_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judging.graded_rollup(graded_chunks(spark, sf_dir), ["code_number", "pdf_path", "criterion"])
    return judging.code_support(verdicts, ("view", "click", "purchase")).drop("papers")


@query("categorical_distribution", f"""WITH {GRADED}, v AS (SELECT pdf_path, criterion, CASE WHEN max(agreement) >= 0.5 THEN 'met' WHEN max(agreement) <= 0 THEN 'not_met' ELSE 'unclear' END AS verdict FROM g GROUP BY ALL)
SELECT criterion, count(*) FILTER (verdict = 'met') AS met, count(*) FILTER (verdict = 'not_met') AS not_met, count(*) FILTER (verdict = 'unclear') AS unclear FROM v GROUP BY ALL""")
def categorical_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judging.graded_rollup(graded_chunks(spark, sf_dir), ["pdf_path", "criterion"])
    return stats.categorical_distribution(verdicts, ["criterion"], "verdict", ["met", "not_met", "unclear"])


@query("graded_histogram", f"WITH {GRADED} SELECT criterion, agreement AS level, count(*) AS n FROM g GROUP BY ALL")
def graded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("criterion"), (F.col("value") / 50 - 1).alias("x"))
    return stats.graded_histogram(e, ["criterion"], "x")


@query("graded_spread", "SELECT event_type AS criterion, count(value) AS n, round(avg(value), 5) + 0.0 AS mean, round(stddev_pop(value), 5) + 0.0 AS std, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY ALL")
def graded_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.graded_spread(table(spark, sf_dir, "events").withColumnRenamed("event_type", "criterion"), ["criterion"], "value")
    return out.withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("weighted_median", """WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) / 2 AS h, lead(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS nx FROM s)
SELECT l_returnflag, CASE WHEN abs(c - h) <= 1e-8 + 1e-5 * abs(h) AND nx IS NOT NULL THEN (v + nx) / 2 ELSE v END AS weighted_median FROM r WHERE c >= h QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY v) = 1""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query("rowwise_aggregates", """WITH p AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b, max(value) FILTER (event_type = 'signup') AS c FROM events GROUP BY ALL),
l AS (SELECT user_id, list_filter([a, b, c], lambda x: x IS NOT NULL) AS v FROM p) SELECT user_id, round(list_avg(v), 5) + 0.0 AS mean, round(list_median(v), 5) + 0.0 AS median, list_min(v) AS min FROM l""")
def rowwise_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    wide = e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in ("view", "click", "signup")])
    values = F.array("view", "click", "signup")
    return wide.select("user_id", rounded(stats.row_aggregate(values, "mean")).alias("mean"), rounded(stats.row_aggregate(values, "median")).alias("median"), stats.row_aggregate(values, "min").alias("min"))


@query("average_ranks", "SELECT p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average_ranks(table(spark, sf_dir, "part"), "p_size", ["p_brand"]).select("p_partkey", "p_size", F.col("rank").cast("double").alias("rank"))


@query("modal_value", "WITH c AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, y::INT AS modal_year FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, y) = 1")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.modal(table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey"], "y", "modal_year")


@query("confusion_quality_toxic", """WITH d AS (SELECT source, coalesce(toxic, 0) = 0 AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) AS n FROM d GROUP BY ALL)
SELECT source, tp, fp, fn, tn, n, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 5) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 5) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 5) AS f1 FROM c""")
def confusion_quality_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("p", F.coalesce("toxic", F.lit(0)) == 0).withColumn("a", F.col("quality") == 1)
    out = stats.confusion(rows, "p", "a", ["source"])
    return out.withColumns({c: F.round(c, 5) for c in ("precision", "recall", "f1")})


@query("tier_counts", "SELECT coalesce(toxic, -1)::INT AS tier, count(*) AS n, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg FROM labels GROUP BY ALL")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("tier", F.coalesce("toxic", F.lit(-1)))
    return stats.tier_counts(rows, ["tier"], F.col("quality") == 1)


@query("verdict_scores", f"WITH {GRADED} SELECT chunk_idx, CASE WHEN agreement >= 0.5 THEN 1.0 WHEN agreement <= 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS ordinal, round(CASE WHEN agreement >= 0.5 THEN 0.67 + 0.33 * pl WHEN agreement <= 0 THEN 0.33 * pl ELSE 0.34 + 0.32 * pl END, 8) + 0.0 AS score FROM (SELECT *, (greatest(-1, least(1, value / 50 - 1)) + 1) / 2 AS pl FROM g)")
def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded_chunks(spark, sf_dir).withColumn("verdict", F.when(F.col("agreement") >= 0.5, "met").when(F.col("agreement") <= 0, "not_met").otherwise("unclear"))
    return g.select("chunk_idx", judging.verdict_ordinal(F.col("verdict")).alias("ordinal"), rounded(judging.band_score(F.col("verdict"), F.col("value") / 50 - 1), 8).alias("score"))


@query("coherence_flags", f"""WITH {GRADED}, v AS (SELECT pdf_path, criterion, CASE WHEN max(agreement) >= 1 THEN 'met' ELSE 'not_met' END AS verdict FROM g GROUP BY ALL),
w AS (SELECT pdf_path, max(verdict) FILTER (criterion = 'view') AS a, max(verdict) FILTER (criterion = 'click') AS b, max(verdict) FILTER (criterion = 'signup') AS c FROM v GROUP BY ALL)
SELECT pdf_path, coalesce(a = 'not_met' AND b IS NOT NULL, false) AS click_vacuous, coalesce(a = 'not_met' AND c IS NOT NULL, false) AS signup_vacuous, (coalesce(a = 'not_met' AND b = 'met', false)::INT + coalesce(a = 'not_met' AND c = 'met', false)::INT) AS n_flags FROM w""")
def coherence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = graded_chunks(spark, sf_dir).groupBy("pdf_path", "criterion").agg(F.when(F.max("agreement") >= 1, "met").otherwise("not_met").alias("verdict"))
    wide = v.groupBy("pdf_path").agg(*[F.max(F.when(F.col("criterion") == c, F.col("verdict"))).alias(c) for c in ("view", "click", "signup")])
    out = judging.coherence(wide, "view", ("click", "signup"))
    return out.select("pdf_path", "click_vacuous", "signup_vacuous", F.size("flags").alias("n_flags"))


@query("usage_cost", "SELECT l_returnflag, count(*) AS calls, round(sum(greatest(0, l_quantity * 100 - l_linenumber * 300)) * 2.0 / 1e6, 5) IS NOT NULL AS priced, round((greatest(0, sum(l_quantity) - sum(l_linenumber)) * 0.5 + sum(l_linenumber) * 0.1 + sum(l_tax * 100) * 1.5) / 1e6, 5) + 0.0 AS cost FROM lineitem GROUP BY ALL")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("cached"), (F.col("l_tax") * 100).alias("completion"), F.lit(0).alias("reasoning"))
    out = judging.usage_cost(calls, ["l_returnflag"], 0.5, 0.1, 1.5)
    return out.select("l_returnflag", "calls", F.col("cost").isNotNull().alias("priced"), rounded("cost").alias("cost"))


@query("unjudged_papers", "SELECT DISTINCT 'doc/' || doc_id AS pdf_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unjudged_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path")
    scores = table(spark, sf_dir, "documents").select(F.lit(1).alias("code_number"), path)
    return corpus.unjudged(scores, table(spark, sf_dir, "labels").select(F.lit(1).alias("code_number"), path))


@query("ranking_dataset", """WITH v AS (SELECT doc_id, CASE quality WHEN 1 THEN 'met' ELSE 'not_met' END AS vq, CASE toxic WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' END AS vt FROM labels)
SELECT d.doc_id % 10 AS code_number, 'doc/' || d.doc_id AS pdf_path, round(n_chars / 1000.0, 5) + 0.0 AS e_quality, round(length(source) / 10.0, 5) + 0.0 AS e_toxic, vq AS v_quality, vt AS v_toxic, CASE vq WHEN 'met' THEN 1.0 WHEN 'not_met' THEN 0.0 END::DOUBLE AS o_quality, CASE vt WHEN 'met' THEN 1.0 WHEN 'not_met' THEN 0.0 END::DOUBLE AS o_toxic
FROM documents d LEFT JOIN v USING (doc_id)""")
def ranking_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    scores = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 10).alias("code_number"), path.alias("pdf_path"),
        F.explode(F.array(F.struct(F.lit("quality").alias("criterion"), (F.col("n_chars") / 1000).alias("e")), F.struct(F.lit("toxic").alias("criterion"), (F.length("source") / 10).alias("e")))).alias("s"),
    ).select("code_number", "pdf_path", "s.*")
    labels = table(spark, sf_dir, "labels")
    quality = F.struct(F.lit("quality").alias("criterion"), F.when(F.col("quality") == 1, "met").otherwise("not_met").alias("verdict"))
    toxic = F.struct(F.lit("toxic").alias("criterion"), F.when(F.col("toxic") == 0, "met").when(F.col("toxic") == 1, "not_met").alias("verdict"))
    verdicts = labels.select(path.alias("pdf_path"), F.explode(F.array(quality, toxic)).alias("s")).select("pdf_path", "s.*")
    out = ranking.ranking_dataset(scores, verdicts, ("quality", "toxic"))
    return out.withColumns({c: rounded(c) for c in ("e_quality", "e_toxic")})


@query("merge_corpus", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < DATE '1995-01-01' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1994-01-01' AND NOT (o_orderdate < DATE '1995-01-01')")
def merge_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("pdf_path", F.col("o_orderkey").cast("string"))
    old, new = orders.where("o_orderdate < '1995-01-01'"), orders.where("o_orderdate >= '1994-01-01'")
    return corpus.merge_corpus(old, new).select("o_orderkey", "o_custkey")


@query("merge_by_source", "SELECT c_custkey, c_mktsegment AS source, c_acctbal FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, c_mktsegment, -c_acctbal + 0.0 FROM customer WHERE c_mktsegment = 'BUILDING'")
def merge_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.gold import merge

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), "c_acctbal")
    new = c.where("source = 'BUILDING'").withColumn("c_acctbal", -F.col("c_acctbal") + F.lit(0.0))
    return merge(c, new, ["BUILDING", "MACHINERY"])


@query("upsert_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not divisible by 5 are there; those divisible by 3 or 5 come, some of them anew."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0 or o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return store.upsert(o.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"])


@query("upsert_some_columns", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def upsert_some_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return store.upsert(o, new, ["o_orderkey"], ["o_totalprice"])


@query("delete_keys", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return store.delete_keys(table(spark, sf_dir, "orders"), dead, ["o_custkey"]).select("o_orderkey", "o_orderstatus")


@query("first_and_last_wins", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY ALL")
def first_and_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = corpus.first_by(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return first.join(corpus.last_by(o, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("work_left", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def work_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.todo(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("download_counts", "SELECT count(*) FILTER (r = 1) AS unique, count(*) FILTER (r > 1) AS duplicate, count(*) FILTER (r = 1 AND ok) AS downloaded, count(*) FILTER (r = 1 AND NOT ok) AS failed FROM (SELECT o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def download_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "F").alias("ok"))
    return corpus.download_counts(rows)


@query("seeded_sample", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 50, 7, table(spark, sf_dir, "labels")).select("doc_id")


@query("json_fields", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import json_object

    return table(spark, sf_dir, "events").select("event_id", F.from_json(json_object(F.col("props")), "k int")["k"].alias("k"))


@query("verdict_rows", "SELECT doc_id % 10 AS code_number, 'doc/' || doc_id AS pdf_path, c AS criterion, v AS verdict FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS c, unnest([CASE quality WHEN 1 THEN 'met' ELSE '' END, CASE toxic WHEN 0 THEN 'met' ELSE 'not_met' END]) AS v FROM labels) WHERE v <> ''")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lambda v: F.struct(v.alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("graded"), F.lit("h").alias("prompt_hash"))
    quality, toxic = F.when(F.col("quality") == 1, "met").otherwise(""), F.when(F.col("toxic") == 0, "met").otherwise("not_met")
    records = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("code_number"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path"), F.create_map(F.lit("quality"), judged(quality), F.lit("toxic"), judged(toxic)).alias("criteria"))
    return store.verdict_rows(records, F.lit("2024-01-01").cast("timestamp")).select("code_number", "pdf_path", "criterion", "verdict")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f) SELECT min(ts) AS start, user_id, count(*) AS n FROM i GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_resume", "SELECT DISTINCT user_id, event_type FROM events")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream over events, each (user, type) once, into Parquet in the shared folder; run twice, as after a stop."""
    root = working_folder(spark, "stream")
    like = table(spark, sf_dir, "events")

    def sink(batch: DataFrame) -> None:
        batch.select("user_id", "event_type").write.mode("append").parquet(f"{root}/out")

    for _ in range(2):
        stream = streams.stream_parquet(spark, sf_dir, like, "events.parquet")
        streams.ingest(stream, ["user_id", "event_type"], sink, f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")
