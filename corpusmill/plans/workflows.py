"""Queries of workflows: injected judges and encoders, a run recomputed in the store, reports, and registered SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register, stats
from ..operators import gold, judging, ranking, reports
from ..sources import readers, store
from .base import doc_vectors, pole_vectors, query, rounded, table, working_folder
from .reports import _BASE, _PAIRS, _pairs, _report, _verdicts
from .scored import _AFFINITY, _CODES, _gold_inputs
from .stored import _stamp, _store


def _complete(system: str, prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise ValueError("no answer")
    return f"{system}:{len(prompt)}"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("system"), F.col("text").alias("prompt"))


@query("judged_replies", "SELECT conv_id, turn, CASE WHEN length(text) % 5 <> 0 THEN role || ':' || length(text) END AS raw, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: no answer' END AS call_error FROM conversations")
def judged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that fail stay with their rows."""
    return judging.judge(_work(spark, sf_dir), _complete).select("conv_id", "turn", "raw", "call_error")


@query("judged_in_rounds", "SELECT conv_id, turn, role || ':' || length(text) AS raw FROM conversations WHERE length(text) % 5 <> 0")
def judged_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished cells are kept round by round; a second run finds them done and asks the failed ones again."""
    path = working_folder(spark, "judged")
    for _ in range(2):
        done = judging.judge_and_keep(_work(spark, sf_dir), path, ["conv_id", "turn"], _complete, 3)
    return done.select("conv_id", "turn", "raw")


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[len(t), t.count(" ")] for t in texts]


@query("embedded_texts", "SELECT item_id, length(text)::FLOAT::DOUBLE AS first, (length(text) - length(replace(text, ' ', '')))::FLOAT::DOUBLE AS second FROM benchmark")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an injected encoder."""
    rows = judging.embed(table(spark, sf_dir, "benchmark"), _lengths)
    return rows.select("item_id", *[F.get("vec", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("first", "second"))])


def _recomputed(spark: SparkSession, sf_dir: str, name: str) -> store.Store:
    s = _store(spark, name)
    docs = doc_vectors(spark, sf_dir).select("code_number", "pdf_path", "method", "chunk_idx", "vec")
    s.upsert("doc_vectors", docs.withColumn("run", F.lit("a")))
    s.upsert("pole_vectors", pole_vectors(spark, sf_dir).withColumn("run", F.lit("a")))
    reports.recompute_run(s, F.col("pdf_path") == "paper/3", 0, 0.0, _stamp(), "a")
    return s



@query("recomputed_run", "SELECT 'paper/' || (vec_id // 5) AS pdf_path, c.criterion, 'a' AS run FROM embeddings, (VALUES ('two_worlds'), ('adaptors'), ('arbitrariness')) AS c(criterion) WHERE vec_id // 5 <> 3 GROUP BY ALL")
def recomputed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's scores anew, without the corpus's own pages; scores lie between -1 and 1."""
    scores = _recomputed(spark, sf_dir, "recomputed").read("embedding_scores", run="a")
    return scores.where(F.col("e").between(-1, 1)).select("pdf_path", "criterion", "run")


@query("run_settings", "SELECT * FROM (VALUES ('whiten_k', '0'), ('shared_strength', '0.0')) AS t(k, v)")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that a recomputation leaves."""
    return _recomputed(spark, sf_dir, "settings").read("run_meta", run="a").select("k", "v")


@query("run_report", "SELECT 'paper/' || (vec_id // 5) AS pdf_path, CASE (vec_id // 5) % 3 WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' END AS verdict, true AS scored FROM embeddings WHERE vec_id // 5 <> 3 GROUP BY ALL")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a paper with its scores and verdicts, beside the report's text."""
    s = _recomputed(spark, sf_dir, "report")
    papers = doc_vectors(spark, sf_dir).select("code_number", "pdf_path").distinct().withColumn("n", F.split_part("pdf_path", F.lit("/"), F.lit(2)).cast("int") % 3)
    judged = papers.where("n < 2").select("code_number", "pdf_path", F.lit("adaptors").alias("criterion"), F.lit("m").alias("model"), F.when(F.col("n") == 0, "met").otherwise("not_met").alias("verdict"))
    s.upsert("verdicts", judged)
    text, wide = reports.main_report(s, "a")
    if "## adaptors" not in text:
        raise ValueError("the report lacks a criterion")
    return wide.select("pdf_path", F.col("adaptors_verdict").alias("verdict"), F.col("adaptors_chunk").isNotNull().alias("scored"))


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """Rows of the tables in a report, but for headers."""
    rows = [x for x in text.split("\n") if x.startswith("| ") and not x.startswith("| criterion")]
    return spark.createDataFrame([(x,) for x in rows], "line string")


@query("gold_report", f"""WITH {_PAIRS}, t AS (SELECT criterion, tier, count(*) AS n, count(*) FILTER (gold_pos) AS p, count(*) FILTER (NOT gold_pos) AS q FROM pr GROUP BY ALL) SELECT '| ' || criterion || ' | ' || tier || ' | ' || n || ' | ' || p || ' | ' || q || ' |' AS line FROM t""")
def gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of tiers as the report has it."""
    text = reports.gold_report(_pairs(spark, sf_dir), "m")
    return _lines(spark, text.split("## Tiers")[1])


@query("comparison_report", f"""WITH {_BASE}, b AS (SELECT criterion, 'old' AS side, verdict FROM vd UNION ALL SELECT criterion, 'new', verdict FROM vd),
t AS (SELECT criterion, side, count(*) FILTER (verdict = 'met') AS m, count(*) FILTER (verdict = 'not_met') AS n, count(*) FILTER (verdict = 'unclear') AS u FROM b GROUP BY ALL) SELECT '| ' || criterion || ' | ' || side || ' | ' || m || ' | ' || n || ' | ' || u || ' |' AS line FROM t""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts before and after as the report has them."""
    v = _verdicts(spark, sf_dir)
    return _lines(spark, reports.comparison_report(v, v, _report(spark, sf_dir)).split("## Correlation")[0])


@query("ranking_page", "SELECT doc_id % 10 AS code_number, 'doc/' || doc_id AS pdf_path FROM documents ORDER BY 1, 2 LIMIT 5000")
def ranking_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers that a page holds (the first 5000 by code and path), read from the page."""
    records = ranking.ranking_dataset(_report(spark, sf_dir).where("method = 'full'"), _verdicts(spark, sf_dir))
    page = reports.ranking_page(records, "Papers")
    rows = json.loads(page.split("const rows = ")[1].split(", criteria = ")[0])
    return spark.createDataFrame([(r["code_number"], r["pdf_path"]) for r in rows], "code_number long, pdf_path string")


@query("implicit_phase", f"{_AFFINITY}, {_CODES} SELECT code_number, pdf_path, 'pos' AS polarity, 'db' AS source FROM pap WHERE code_number IN (SELECT code_number FROM mol) UNION ALL SELECT code_number, pdf_path, 'neg', 'implicit' FROM pap JOIN dom USING (pdf_path) WHERE code_number <> 0 AND code_number NOT IN (SELECT code_number FROM mol) AND topic_id % 2 <> 0")
def implicit_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft negatives in place of the ones before, beside rows of other sources."""
    papers, dominants, allowed, labels = _gold_inputs(spark, sf_dir)
    molecular = gold.molecular_codes(papers, dominants, allowed)
    row = lambda df, polarity, source: df.select("code_number", "pdf_path", F.lit(polarity).alias("polarity"), F.lit("2").alias("tier"), F.lit(source).alias("source"), F.lit("all").alias("criterion"), F.lit("e").alias("evidence"))
    known = row(papers.join(molecular.select("code_number"), "code_number", "left_semi"), "pos", "db").unionByName(row(papers, "neg", "implicit"))
    return gold.implicit_phase(known, papers, dominants, allowed, labels).select("code_number", "pdf_path", "polarity", "source")


@query("prototype_passages", "SELECT r_name AS criterion, p AS pole, 0 AS passage_no, r_name || ' ' || p AS text FROM region, (VALUES ('pos'), ('neg')) AS t(p)")
def prototype_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the poles from one JSON object."""
    path = working_folder(spark, "prototypes")
    one = lambda pole: F.array(F.concat(F.col("r_name"), F.lit(f" {pole}"))).alias(pole)
    poles = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.struct(one("pos"), one("neg")).alias("value"))
    poles.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value")).write.text(path)
    return readers.prototype_passages(spark, readers.load_prototypes(spark, path))


@query("document_files", "SELECT n_name || chr(10) AS text FROM nation")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as a whole, one a row."""
    path = working_folder(spark, "files")
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    return readers.read_documents(spark, f"{path}/*/").select("text")


@query("retried_work", "SELECT 3 AS attempts, 'done' AS result")
def retried_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transient errors twice, then a result."""
    attempts = []

    def work() -> str:
        attempts.append(1)
        if len(attempts) < 3:
            raise ConnectionError("gone")
        return "done"

    result = store.with_retry(work, sleep=lambda _: None)
    return spark.createDataFrame([(len(attempts), result)], "attempts int, result string")


@query("score_spread", f"WITH {_BASE} SELECT criterion, method, count(*) AS n, round(avg(e), 5) + 0.0 AS mean, round(stddev_pop(e), 5) + 0.0 AS std FROM rp GROUP BY ALL")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 by criterion and method."""
    out = stats.graded_spread(_report(spark, sf_dir), ["criterion", "method"], "e")
    return out.select("criterion", "method", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("sql_functions", "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded, 1.0::DOUBLE AS coverage FROM benchmark")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by name in SQL text."""
    register.register(spark)
    return table(spark, sf_dir, "benchmark").selectExpr("item_id", "fold_spaces(text) AS folded", "quote_coverage(text, concat('so: ', text)).coverage AS coverage")
