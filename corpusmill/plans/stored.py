"""Queries of the store, its sinks and readers, page layout and text structure: data go out in a format and come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gold, judging, layout, prompts
from ..sources import readers, store
from .base import query, rounded, table, working_folder


def _stamp() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _store(spark: SparkSession, name: str) -> store.Store:
    return store.Store(spark, working_folder(spark, f"store-{name}"))


# The store: rows come in twice, the second time with other values for a part of the keys


@query("store_scores", "SELECT vec_id::INT AS code_number, label AS criterion_no, CASE WHEN vec_id % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS e, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings")
def store_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a run upserted, and only that run read."""
    s, e = _store(spark, "scores"), table(spark, sf_dir, "embeddings")
    rows = lambda run, value, model: e.select(F.lit(run).alias("run"), F.col("vec_id").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("full").alias("method"), F.col("label").cast("string").alias("criterion"), F.lit(value).alias("e"), F.lit(model).alias("model"), _stamp().alias("run_ts"))
    s.upsert("embedding_scores", rows("a", 1.0, "old").unionByName(rows("b", 9.0, "old")))
    s.upsert("embedding_scores", rows("a", 2.0, "new").where("code_number % 2 = 0"))
    return s.read("embedding_scores", run="a").select("code_number", F.col("criterion").cast("int").alias("criterion_no"), "e", "model")


@query("store_rescored", "SELECT vec_id::INT AS code_number, 2.0::DOUBLE AS e, 'old' AS model FROM embeddings")
def store_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a recomputation takes over the score and leaves the model."""
    s, e = _store(spark, "rescored"), table(spark, sf_dir, "embeddings")
    rows = lambda value, model: e.select(F.lit("a").alias("run"), F.col("vec_id").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("full").alias("method"), F.lit("c").alias("criterion"), F.lit(value).alias("e"), F.lit(model).alias("model"), _stamp().alias("run_ts"))
    s.upsert("embedding_scores", rows(1.0, "old"))
    s.upsert("embedding_scores", rows(2.0, "new"), ["e", "run_ts"])
    return s.read("embedding_scores").select("code_number", "e", "model")


@query("store_verdicts", "SELECT doc_id::INT AS code_number, 'j' || (doc_id % 3) AS model, CASE quality WHEN 1 THEN 'met' ELSE 'not_met' END AS verdict FROM labels")
def store_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: verdicts by judge; what was unclear is overwritten."""
    s = _store(spark, "verdicts")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("c").alias("criterion"), F.concat(F.lit("j"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.when(F.col("quality") == 1, "met").otherwise("not_met").alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("graded"), F.lit("h").alias("prompt_hash"), _stamp().alias("run_ts"))
    s.upsert("verdicts", rows.withColumn("verdict", F.lit("unclear")))
    s.upsert("verdicts", rows)
    return s.read("verdicts").select("code_number", "model", "verdict")


@query("store_chunk_verdicts", "SELECT event_id::INT AS chunk_idx, value AS agreement, CASE WHEN event_type = 'view' THEN 'again' ELSE 'once' END AS prompt_hash FROM events WHERE user_id % 2 = 0 OR event_type <> 'error'")
def store_chunk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by judge, some judged again; those of one judge that are errors are deleted."""
    s, e = _store(spark, "cells"), table(spark, sf_dir, "events")
    cells = e.select(F.lit(1).alias("code_number"), F.col("event_type").alias("pdf_path"), F.lit("c").alias("criterion"), F.col("event_id").cast("int").alias("chunk_idx"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.col("value").alias("agreement"), F.lit(1.0).alias("confidence"), F.lit("").alias("evidence_quote"), F.col("value").alias("raw_agreement"), F.lit(None).cast("double").alias("coverage"), F.lit(False).alias("grounding_failed"), F.lit("once").alias("prompt_hash"), _stamp().alias("run_ts"))
    s.upsert("chunk_verdicts", cells)
    s.upsert("chunk_verdicts", cells.where("pdf_path = 'view'").withColumn("prompt_hash", F.lit("again")))
    s.delete("chunk_verdicts", cells.where("pdf_path = 'error' and model = 'odd'"), ["pdf_path", "model"])
    of = lambda judge: judging.by_judge(s.read("chunk_verdicts"), judge)
    return of("even").unionByName(of("odd")).select("chunk_idx", "agreement", "prompt_hash")


@query("store_gold", "SELECT doc_id::INT AS code_number, CASE quality WHEN 1 THEN 'pos' ELSE 'neg' END AS polarity, CASE doc_id % 2 WHEN 0 THEN 'all' ELSE 'adaptors' END AS criterion, 'second' AS evidence FROM labels")
def store_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows with their criterion made whole, upserted twice."""
    s = _store(spark, "gold")
    raw = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("polarity"), F.lit("1").alias("tier"), F.lit("db").alias("source"), F.when(F.col("doc_id") % 2 == 1, "adaptors").when(F.col("doc_id") % 4 == 0, " ").alias("criterion"), F.lit("first").alias("evidence"))
    s.upsert("gold_labels", store.gold_to_rows(raw))
    s.upsert("gold_labels", store.gold_to_rows(raw.withColumn("evidence", F.lit("second"))))
    return s.read("gold_labels").select("code_number", "polarity", "criterion", "evidence")


@query("store_gold_by_key", "SELECT c_nationkey AS code_number, max(CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END) AS polarity FROM customer GROUP BY ALL")
def store_gold_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label a key without its polarity: of both polarities the positive one."""
    s = _store(spark, "gold-key")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code_number"), F.lit("p").alias("pdf_path"), F.when(F.col("c_acctbal") > 0, "pos").otherwise("neg").alias("polarity"), *[F.lit("x").alias(n) for n in ("tier", "source", "criterion", "evidence")])
    s.upsert("gold_labels", c)
    return store.gold_by_key(s.read("gold_labels")).select("code_number", "polarity")


@query("store_prompts", "SELECT count(*) AS n, count(DISTINCT criterion) AS criteria FROM (VALUES ('two_worlds'), ('adaptors'), ('arbitrariness')) AS c(criterion)")
def store_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: registered again, a template keeps one row."""
    s = _store(spark, "prompts")
    asked = spark.createDataFrame([(c,) for c in prompts.CRITERIA], "criterion string")
    for _ in range(2):
        s.upsert("prompt_registry", prompts.registry(asked).withColumn("registered_ts", _stamp()))
    return s.read("prompt_registry").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("criterion").alias("criteria"))


@query("store_topics", "SELECT vec_id::INT AS chunk_idx, label AS topic_id, 'label ' || label AS name FROM embeddings")
def store_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids and chunk topics of a run, read back by run and method."""
    s, e = _store(spark, "topics"), table(spark, sf_dir, "embeddings")
    s.upsert("topic_centroids", e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.lit("a").alias("run"), F.col("label").alias("topic_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), "vec"))
    rows = e.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run"), F.lit(1).alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("chunk").alias("method"), F.col("vec_id").cast("int").alias("chunk_idx"), F.col("label").alias("topic_id"), F.lit(1.0).alias("similarity"))
    s.upsert("chunk_topics", rows.unionByName(rows.where("run = 'a'").withColumn("method", F.lit("full"))))
    names = s.read("topic_centroids", run="a").select("topic_id", F.col("label").alias("name"))
    return s.read("chunk_topics", run="a", method="chunk").join(names, "topic_id").select("chunk_idx", "topic_id", "name")


@query("store_vectors", "SELECT 'doc' AS kind, vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings UNION ALL SELECT 'control', vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 FROM embeddings")
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of papers and controls by run; a paper's list of vectors becomes numbered rows."""
    s, e = _store(spark, "vectors"), table(spark, sf_dir, "embeddings")
    payload = e.select(F.concat_ws("/", "vec_id", "label").alias("pdf_path"), F.create_map(F.lit("full"), F.array("embedding")).alias("vectors"))
    s.upsert("doc_vectors", store.vectors_to_rows(payload, e.select(F.concat_ws("/", "vec_id", "label").alias("pdf_path"), F.col("vec_id").cast("int").alias("code_number")), "a"))
    s.upsert("control_vectors", e.select(F.lit("a").alias("run"), F.concat_ws("/", "vec_id", "label").alias("name"), F.col("embedding").alias("vec")))
    of = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.split_part(key, F.lit("/"), F.lit(1)).cast("long").alias("vec_id"), F.split_part(key, F.lit("/"), F.lit(2)).cast("int").alias("label"), rounded(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
    return of("doc", s.read("doc_vectors", run="a").where("chunk_idx = 0 and code_number is not null"), F.col("pdf_path")).unionByName(of("control", s.read("control_vectors", run="a"), F.col("name")))


@query("store_run", "SELECT 'k' AS k, '2' AS v UNION ALL SELECT 'model', 'm'")
def store_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are there from the start, and settings of a run are rows."""
    s = _store(spark, "run")
    s.init()
    s.upsert("run_meta", store.meta_to_rows(spark, {"k": 1, "model": "m"}, "a"))
    s.init()
    s.upsert("run_meta", store.meta_to_rows(spark, {"k": 2}, "a"))
    return s.read("run_meta", run="a").select("k", "v")


@query("store_catalog", """SELECT * FROM (VALUES ('control_scores', 5, 'run,name,criterion'), ('doc_vectors', 6, 'run,code_number,pdf_path,method,chunk_idx'), ('gold_labels', 7, 'code_number,pdf_path,polarity,criterion'), ('verdicts', 9, 'code_number,pdf_path,criterion,model')) AS t(name, n_columns, key_columns)""")
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as stored, and keys."""
    s = _store(spark, "catalog")
    s.init()
    rows = [(t, len(s.columns(t)), ",".join(s.key_columns(t))) for t in ("control_scores", "doc_vectors", "gold_labels", "verdicts")]
    return spark.createDataFrame(rows, "name string, n_columns int, key_columns string")


@query("migrated_scores", "SELECT vec_id::INT AS code_number, 'baseline' AS run, CASE WHEN label > 4 THEN 'm' END AS model FROM embeddings")
def migrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: scores from before there were runs."""
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("full").alias("method"), F.lit("c").alias("criterion"), F.lit(1.0).alias("e"), F.when(F.col("label") > 4, "m").alias("model"))
    return store.migrate(old, "embedding_scores").select("code_number", "run", "model")


@query("migrated_verdicts", "SELECT DISTINCT o_custkey::INT AS code_number, o_orderpriority AS criterion, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'unknown' END AS model, 'met' AS verdict FROM orders")
def migrated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: verdicts that score rows carried, one a key, with a judge where none was named."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("code_number"), F.lit("p").alias("pdf_path"), F.col("o_orderpriority").alias("criterion"), F.when(F.col("o_orderstatus") == "F", "F").alias("model"), F.lit("met").alias("verdict"), F.lit(1.0).alias("confidence"))
    return store.migrate(store.latest_verdicts_from_scores(old), "verdicts").select("code_number", "criterion", "model", "verdict")


@query("payload_scores", "SELECT vec_id::INT AS code_number, m AS method, c AS criterion, label::DOUBLE AS e FROM embeddings, (VALUES ('full'), ('chunk')) AS a(m), (VALUES ('x'), ('y')) AS b(c)")
def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scores at the grain of the table, with their codes."""
    e, path = table(spark, sf_dir, "embeddings"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("pdf_path")
    inner = F.create_map(F.lit("x"), F.col("label").cast("double"), F.lit("y"), F.col("label").cast("double"))
    payload = e.select(path, F.create_map(F.lit("full"), inner, F.lit("chunk"), inner).alias("scores"), F.lit("m").alias("model"))
    rows = store.scores_to_rows(payload, e.select(path, F.col("vec_id").cast("int").alias("code_number")), "a", _stamp())
    return rows.select("code_number", "method", "criterion", "e")


@query("payload_poles", "SELECT label::VARCHAR AS criterion, p AS pole, round(embedding[CASE p WHEN 'pos' THEN 1 ELSE 2 END]::DOUBLE, 5) + 0.0 AS first FROM embeddings, (VALUES ('pos'), ('neg')) AS a(p) WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)")
def payload_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a pole."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("criterion")).agg(F.min_by("embedding", "vec_id").alias("v"))
    rows = store.poles_to_rows(e.select("criterion", F.col("v").alias("pos"), F.slice("v", 2, 9).alias("neg")), "a")
    return rows.select("criterion", "pole", rounded(F.get("vec", F.lit(0)).cast("double")).alias("first"))


# Sinks and readers


@query("json_snapshot", "SELECT doc_id::VARCHAR AS pdf_path, 'quality' AS criterion, quality::VARCHAR AS verdict FROM labels WHERE toxic = 1")
def json_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of some papers as JSON lines, and read again."""
    path, rows = working_folder(spark, "snapshot"), table(spark, sf_dir, "labels")
    verdicts = rows.select(F.col("doc_id").cast("string").alias("pdf_path"), F.lit("quality").alias("criterion"), F.col("quality").cast("string").alias("verdict"))
    store.export_json(verdicts, path, rows.where("toxic = 1").select(F.col("doc_id").cast("string").alias("pdf_path")))
    return readers.read_snapshot(spark, path)


@query("json_strict", "SELECT event_id, user_id FROM events")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended in two goes."""
    path, e = working_folder(spark, "lines"), table(spark, sf_dir, "events").select("event_id", "user_id")
    store.export_json(e.where("user_id < 50"), path)
    store.export_json(e.where("user_id >= 50"), path)
    return readers.read_jsonl_strict(spark, path, "event_id long, user_id long")


@query("done_papers", "SELECT DISTINCT user_id AS pdf_path FROM events")
def done_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    return readers.done_keys(table(spark, sf_dir, "events").select(F.col("user_id").alias("pdf_path"), "value"), ["pdf_path"])


@query("done_windows", "SELECT DISTINCT conv_id AS pdf_path, turn AS chunk_idx FROM conversations")
def done_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15."""
    return readers.done_keys(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pdf_path"), F.col("turn").alias("chunk_idx"), "text"), ["pdf_path", "chunk_idx"])


@query("json_cache", "SELECT p_brand AS key, max(p_name) AS value FROM part GROUP BY ALL")
def json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cache as one JSON object."""
    path = working_folder(spark, "cache")
    known = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_name").alias("v"))
    known.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "v")))).alias("value")).write.text(path)
    return readers.read_cache(spark, path)


def _csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    """A small dimension as one CSV file in the order given."""
    path = working_folder(spark, name)
    store.export_csv(df, path)
    return path


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as citations: odd names with quotes and line breaks, some without a link, several of one link."""
    key = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(key % 3 == 0, F.lit(', "so"\nand on')).otherwise(""))
    url = F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" https://doi.org/10.1000/x"), F.floor(key / 2).cast("string"), F.lit(" ")))
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.when(key % 11 == 0, "n/a").otherwise((key % 50).cast("string")).alias("Code Number"), F.col("p_type").alias("Code Name"), F.when(key % 4 == 0, " ").otherwise(name).alias("Paper Name"), url.alias("URL"))
    return readers.read_citations(spark, _csv(spark, rows, "citations"))


_CITED = """ct AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE (p_partkey % 50)::VARCHAR END AS code_number, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN p_name || ', "so"' || chr(10) || 'and on' ELSE p_name END AS paper_name,
'10.1000_x' || (p_partkey // 2) AS file, p_type FROM part WHERE p_partkey % 7 <> 0)"""


@query("csv_citations", f"WITH {_CITED} SELECT code_number, nullif(trim(paper_name), '') AS paper_name, count(*) AS n FROM ct GROUP BY ALL")
def csv_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, K16; a blank name is written as nothing and read as null."""
    return _citations(spark, sf_dir).groupBy("code_number", F.trim("paper_name").alias("paper_name")).agg(F.count(F.lit(1)).alias("n"))


@query("csv_code_names", "SELECT (p_partkey % 50)::INT AS code_number, arg_min(p_type, p_partkey) AS code_name FROM part WHERE p_partkey % 11 <> 0 GROUP BY ALL")
def csv_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of each number."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.when(key % 11 == 0, "n/a").otherwise((key % 50).cast("string")).alias("Code Number"), F.col("p_type").alias("Code Name"))
    return readers.read_code_names(spark, _csv(spark, rows, "names"))


@query("csv_paper_names", f"WITH {_CITED} SELECT 'pdfs/' || file || '.pdf' AS pdf_path, arg_min(paper_name, k) AS paper_name FROM ct WHERE trim(paper_name) <> '' GROUP BY ALL")
def csv_paper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F2: the first name of each path that is not blank."""
    return readers.paper_names(_citations(spark, sf_dir), "pdfs")


@query("csv_citations_by_file", f"WITH {_CITED} SELECT file || '.pdf' AS basename, arg_max(p_type, k) AS code_name FROM ct GROUP BY ALL")
def csv_citations_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last citation of each file."""
    return readers.citations_by_file(_citations(spark, sf_dir), "pdfs").select("basename", "code_name")


def _topic_csv(spark: SparkSession, sf_dir: str) -> str:
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").orderBy(n).select(F.concat(F.lit(" "), n.cast("string")).alias("Topic #"), F.concat(F.col("n_name"), F.lit(" ")).alias("Label"), F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("Text of\n"), F.col("n_name"))).alias("Centroid Text"))
    return _csv(spark, rows, "topics")


@query("csv_topics", "SELECT n_nationkey AS topic_id, n_name AS label, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Text of' || chr(10) || n_name END AS centroid_text FROM nation")
def csv_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5."""
    return readers.read_topics(spark, _topic_csv(spark, sf_dir)).withColumn("centroid_text", F.coalesce("centroid_text", F.lit("")))


@query("csv_centroid_texts", "SELECT n_nationkey AS topic_id, n_name AS label FROM nation WHERE n_nationkey % 5 <> 0")
def csv_centroid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6."""
    return readers.read_centroid_texts(spark, _topic_csv(spark, sf_dir)).select("topic_id", "label")


def _allowed_csv(spark: SparkSession, sf_dir: str) -> str:
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").orderBy(n).select(F.when(n == 7, "none").otherwise(n.cast("string")).alias("topic_id"), F.col("n_name").alias("label"), F.when(n % 2 == 0, " Yes").otherwise("no").alias("molecular"))
    return _csv(spark, rows, "allowed")


@query("csv_allowed_topics", "SELECT n_nationkey AS topic_id, n_name AS label FROM nation WHERE n_nationkey % 2 = 0")
def csv_allowed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7."""
    return readers.read_allowed_topics(spark, _allowed_csv(spark, sf_dir))


@query("csv_topic_labels", "SELECT n_nationkey AS topic_id, n_name AS label FROM nation WHERE n_nationkey <> 7")
def csv_topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8."""
    return readers.read_topic_labels(spark, _allowed_csv(spark, sf_dir))


@query("csv_gold", "SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END::INT AS code_number, c_name AS pdf_path, 'a \"b\", c' AS evidence FROM customer")
def csv_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9; a file that is missing gives no rows."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(key % 9 == 0, "?").otherwise(key.cast("string")).alias("code_number"), F.col("c_name").alias("pdf_path"), *[F.lit("x").alias(c) for c in ("polarity", "tier", "source", "criterion")], F.lit('a "b", c').alias("evidence"))
    none = readers.read_gold(spark, working_folder(spark, "absent"))
    return readers.read_gold(spark, _csv(spark, rows, "gold")).unionByName(none).select("code_number", "pdf_path", "evidence")


@query("csv_manifest", "SELECT s_name AS source_file, '' AS paper_name, CASE WHEN s_suppkey % 2 = 0 THEN 'u' ELSE '' END AS url FROM supplier")
def csv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks and missing columns are empty."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.col("s_name")).alias("Source File"), F.when(F.col("s_suppkey") % 2 == 0, "u ").alias("URL"))
    return readers.read_manifest(spark, _csv(spark, rows, "manifest")).drop("position")


# Page layout: parts as rows of a reference table, ten a page and twenty pages a document


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Characters and links: every page's first row goes on with the code before it, unless it begins a document."""
    key = F.col("p_partkey")
    at = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(key / 200).cast("int").alias("doc"), (F.floor(key / 10) % 20).cast("int").alias("page"), (key % 10).cast("int").alias("r"))
    at = at.withColumn("top", (F.col("r") * 50 + 20).cast("double")).withColumn("numbered", (F.col("r") > 0) | (F.col("page") == 0)).withColumn("linked", key % 3 != 0)
    char = lambda x, text, dy: F.struct(F.lit(float(x)).alias("x0"), F.lit(x + 10.0).alias("x1"), (F.col("top") + dy).alias("top"), (F.col("top") + dy + 8).alias("bottom"), text.alias("text"))
    number = F.when(F.col("numbered"), char(40, key.cast("string"), 0.0))
    named = [F.when(F.col("numbered"), char(100, F.split_part("p_name", F.lit(" "), F.lit(1)), 0.0)), F.when(F.col("numbered"), char(100, F.split_part("p_name", F.lit(" "), F.lit(2)), 10.0))]
    cited = [char(350, F.lit("Doe J ("), 0.0), char(360, (1950 + key % 50).cast("string"), 0.0), char(370, F.lit(")"), 0.0), char(345, F.concat(F.lit("part "), key.cast("string")), 10.0)]
    other = [char(210, F.lit("described"), 0.0)]
    chars = at.select("doc", "page", F.explode(F.array_compact(F.array(number, *named, *cited, *other))).alias("c")).select("doc", "page", "c.*")
    chars = chars.unionByName(chars.select("doc", "page").distinct().select("doc", "page", F.lit(400.0).alias("x0"), F.lit(410.0).alias("x1"), F.lit(545.0).alias("top"), F.lit(553.0).alias("bottom"), F.lit("footer").alias("text")))
    uri = F.concat(F.lit("http://x/"), key.cast("string"))
    rect = lambda dy, u, x=344.0: F.struct(F.lit(x).alias("x0"), F.lit(x + 40).alias("x1"), (F.col("top") + dy).alias("top"), (F.col("top") + dy + 8).alias("bottom"), u.alias("uri"))
    links = at.select("doc", "page", F.explode(F.array(F.when(F.col("linked"), rect(0.0, uri)), F.when(F.col("linked"), rect(10.0, uri)), rect(0.0, F.lit("mailto:x")), rect(0.0, F.lit("http://left"), 100.0))).alias("l")).where("l is not null")
    return chars, links.select("doc", "page", "l.*")


_LAID = """pg AS (SELECT p_partkey AS k, p_name, (p_partkey // 200)::INT AS doc, ((p_partkey // 10) % 20)::INT AS page, p_partkey % 10 AS r, p_partkey % 3 <> 0 AS linked FROM part),
cd AS (SELECT *, CASE WHEN r > 0 OR page = 0 THEN k ELSE k - 1 END::INT AS code_number FROM pg)"""


@query("layout_references", f"""WITH {_LAID}, bare AS (SELECT doc, code_number FROM cd GROUP BY ALL HAVING count(*) FILTER (linked) = 0),
rf AS (SELECT doc, code_number, 'Doe J (' || (1950 + k % 50) || ') part ' || k AS paper_name, 'http://x/' || k AS url FROM cd WHERE linked
UNION ALL SELECT doc, code_number, 'Doe J (' || (1950 + k % 50) || ') part ' || k, '' FROM cd JOIN bare USING (doc, code_number)) SELECT rf.doc, rf.code_number, p_name AS code_name, paper_name, url FROM rf JOIN part ON p_partkey = code_number""")
def layout_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as references."""
    return layout.extract_references(*_page(spark, sf_dir), ["doc"])


@query("layout_bands", f"WITH {_LAID}, a AS (SELECT doc, page, r, code_number FROM cd) SELECT doc, page, CASE WHEN r = 0 AND page > 0 THEN 0 ELSE r * 50 + 15 END::INT AS top0, CASE WHEN r = 9 THEN 540 ELSE r * 50 + 65 END::INT AS top1, code_number FROM a")
def layout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bands, the first of a page carried over."""
    return layout.bands(_page(spark, sf_dir)[0], ["doc"])


@query("layout_text", f"WITH {_LAID} SELECT doc, page, string_agg('Doe J (' || (1950 + k % 50) || ') part ' || k, ' ' ORDER BY r) AS text FROM pg GROUP BY ALL")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column in reading order, without the footer."""
    return layout.reading_text(layout.in_column(_page(spark, sf_dir)[0], "citations"), ["doc", "page"])


@query("layout_links", f"WITH {_LAID} SELECT doc, page, 'http://x/' || k AS uri, 2 AS n FROM pg WHERE linked")
def layout_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    links = layout.citation_links(_page(spark, sf_dir)[1])
    return links.groupBy("doc", "page", "uri").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("layout_runs", f"WITH {_LAID} SELECT doc, page, 'http://x/' || k AS uri, row_number() OVER (PARTITION BY doc ORDER BY page, r) AS run, 2 AS n FROM pg WHERE linked")
def layout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that follow each other with one target are one reference."""
    runs = layout.link_runs(layout.citation_links(_page(spark, sf_dir)[1]), ["doc"])
    return runs.groupBy("doc", "page", "uri", "run").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("layout_mismatches", f"WITH {_LAID}, c AS (SELECT doc, code_number, count(*)::INT AS expected, count(*) FILTER (linked) AS found FROM cd GROUP BY ALL) SELECT * FROM c WHERE expected <> found")
def layout_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with more or fewer years than links."""
    return layout.citation_mismatches(*_page(spark, sf_dir), ["doc"])


@query("same_role_runs", """WITH f AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND turn > min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f) SELECT conv_id, run::BIGINT AS run, role, count(*) AS n_turns FROM i GROUP BY ALL""")
def same_role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 over turns in the place of links."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.lit(0).alias("page"), F.col("turn").cast("double").alias("top"), F.lit(0).alias("x0"), F.col("role").alias("uri"), "role")
    return layout.link_runs(rows, ["conv_id"]).groupBy("conv_id", "run", "role").agg(F.count(F.lit(1)).alias("n_turns"))


# Text structure


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between headings: a preamble, an abstract, results twice and references."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    entries = F.concat(F.lit("Doe J, Work on ("), (1900 + F.col("doc_id") % 100).cast("string"), F.lit(")\n  goes on\nRoe, A. Other (1999)\n"))
    parts = [F.lit("A title"), F.lit("1. ABSTRACT:"), flat, F.lit("Results"), F.lit("First."), F.lit("2 Results"), F.lit("Second."), F.lit("References"), entries]
    return table(spark, sf_dir, "documents").select("doc_id", flat.alias("flat"), F.array_join(F.array(*parts), "\n").alias("text"))


_FLAT = "fl AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)"


_ABSTRACT = "'1. ABSTRACT:' || CASE flat WHEN '' THEN '' ELSE chr(10) || flat END"
_RESULTS = "'Results' || chr(10) || 'First.' || chr(10) || '2 Results' || chr(10) || 'Second.'"
_CITING = "'References' || chr(10) || 'Doe J, Work on (' || (1900 + doc_id % 100) || ')' || chr(10) || '  goes on' || chr(10) || 'Roe, A. Other (1999)'"


@query("sections", f"""WITH {_FLAT} SELECT doc_id, x.section, x.body FROM (SELECT doc_id, unnest([{{section: '_preamble', body: 'A title'}}, {{section: 'abstract', body: {_ABSTRACT}}}, {{section: 'results', body: {_RESULTS}}}, {{section: 'references', body: {_CITING}}}]) AS x FROM fl)""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return X.sections(_papers(spark, sf_dir), "doc_id", "text")


@query("section_abstracts", f"WITH {_FLAT} SELECT doc_id, left({_ABSTRACT}, 4000) AS abstract FROM fl")
def section_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 over headings."""
    return X.abstracts(_papers(spark, sf_dir), "doc_id", "text")


@query("section_budget", f"""WITH {_FLAT}, p AS (SELECT doc_id, {_ABSTRACT} AS a, 'A title' || chr(10) || '1. ABSTRACT:' || chr(10) || flat || chr(10) || {_RESULTS} || chr(10) || {_CITING} || chr(10) AS whole FROM fl), f AS (SELECT *, 8 + length(a) <= 358 AS fits FROM p)
SELECT doc_id, CASE WHEN floor(length(whole) / 3.58) <= 100 THEN whole ELSE 'A title' || CASE WHEN fits THEN chr(10) || a ELSE '' END || CASE WHEN NOT fits OR 8 + length(a) + 33 <= 358 THEN chr(10) || {_RESULTS} ELSE '' END END AS text FROM f""")
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 over headings: sections that overflow the budget are passed over."""
    return X.within_budget(_papers(spark, sf_dir), "doc_id", "text", 100)


@query("reference_entries", "SELECT doc_id, x.n AS entry_no, x.entry FROM (SELECT doc_id, unnest([{n: 1::BIGINT, entry: 'Doe J, Work on (' || (1900 + doc_id % 100) || ') goes on'}, {n: 2::BIGINT, entry: 'Roe, A. Other (1999)'}]) AS x FROM documents)")
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9 over the reference sections."""
    body = X.sections(_papers(spark, sf_dir), "doc_id", "text").where("section = 'references'")
    return X.reference_entries(body, "doc_id", "body").select("doc_id", "entry_no", F.trim("entry").alias("entry"))


@query("cited_signatures", "SELECT DISTINCT 'doe' AS surname, (1900 + doc_id % 100)::VARCHAR AS year FROM documents UNION SELECT 'roe', '1999' FROM documents")
def cited_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    return gold.cited_signatures(_papers(spark, sf_dir), "doc_id")


@query("cite_phase", """WITH c AS (SELECT DISTINCT 'doe' AS s, (1900 + doc_id % 100)::VARCHAR AS y FROM documents), g AS (SELECT p_partkey, 'Doe J (' || (1850 + p_partkey % 100) || ')' AS n, (1850 + p_partkey % 100)::VARCHAR AS y, p_partkey % 3 > 0 AS pos FROM part)
SELECT p_partkey::INT AS code_number, CASE WHEN pos AND c.s IS NOT NULL THEN '1' ELSE '2' END AS tier, CASE WHEN pos AND c.s IS NOT NULL THEN 'cite' ELSE 'db' END AS source, CASE WHEN pos AND c.s IS NOT NULL THEN 'e | cited: doe ' || g.y ELSE 'e' END AS evidence FROM g LEFT JOIN c ON c.y = g.y""")
def cite_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier-2 positives that the reference sections cite become tier 1."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("code_number"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pdf_path"))
    known = part.select("code_number", "pdf_path", F.when(F.col("code_number") % 3 > 0, "pos").otherwise("neg").alias("polarity"), F.lit("2").alias("tier"), F.lit("db").alias("source"), F.lit("all").alias("criterion"), F.lit("e").alias("evidence"))
    names = part.select("pdf_path", F.concat(F.lit("Doe J ("), (1850 + F.col("code_number") % 100).cast("string"), F.lit(")")).alias("paper_name"))
    return gold.cite_phase(known, names, _papers(spark, sf_dir), "doc_id").select("code_number", "tier", "source", "evidence")


@query("method_texts", f"""WITH {_FLAT}, n AS (SELECT doc_id, flat, string_split(flat, ' ') AS w FROM fl WHERE flat <> ''), s AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 64 THEN 1 ELSE ceil((len(w) - 64) / 32.0)::BIGINT + 1 END)) AS i FROM n)
SELECT doc_id, 'full' AS method, 0 AS chunk_idx, md5(flat) AS text_md5 FROM n UNION ALL SELECT doc_id, 'abstract', 0, md5(left(flat, 100)) FROM n UNION ALL SELECT doc_id, 'chunk', i::INT, md5(array_to_string(list_slice(w, i * 32 + 1, i * 32 + 64), ' ')) FROM s""")
def method_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are embedded: whole, abstract and windows of words."""
    papers = _papers(spark, sf_dir).select(F.col("doc_id").alias("code_number"), F.lit("p").alias("pdf_path"), F.col("flat").alias("text"))
    windows = F.transform(X.token_windows(X.whitespace_tokens(F.col("text")), 64, 32), lambda w: F.array_join(w, " "))
    made = judging.method_texts(papers, windows, F.left("text", F.lit(100)))
    return made.select(F.col("code_number").alias("doc_id"), "method", "chunk_idx", F.md5("text").alias("text_md5"))


@query("payload", f"WITH {_FLAT} SELECT doc_id AS pdf_path, left(flat, 500) AS \"full\", left(flat, 4000) AS abstract FROM fl")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return prompts.payload(_papers(spark, sf_dir).select(F.col("doc_id").alias("pdf_path"), F.col("flat").alias("text")), 500)


@query("resolved_links", "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/paper.pdf' AS link FROM pages")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a meta tag put into each page, its relative link made absolute."""
    meta = F.lit("<meta content='/paper.pdf' name=\"citation_pdf_url\">")
    return table(spark, sf_dir, "pages").select("page_id", X.resolved(X.citation_link(F.concat(F.col("html"), meta)), F.col("url")).alias("link"))


@query("sniffed_pages", "SELECT page_id, page_id % 3 = 0 AS pdf, page_id % 3 > 0 AS html FROM pages")
def sniffed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by first bytes or declared type."""
    id = F.col("page_id")
    head = F.when(id % 6 == 0, "%PDF-1.7 ..").when(id % 3 == 0, "").when(id % 3 == 1, F.concat(F.lit("\n "), F.col("html"))).otherwise("<div>").cast("binary")
    kind = F.when((id % 6 != 0) & (id % 3 == 0), "Application/PDF; x").when(id % 3 == 2, "text/html")
    return table(spark, sf_dir, "pages").select("page_id", X.looks_like_pdf(head, kind).alias("pdf"), X.looks_like_html(head, kind).alias("html"))


@query("open_urls", "SELECT page_id, array_to_string(CASE page_id % 3 WHEN 0 THEN [url || '.pdf', 'http://o/2.pdf', url, 'http://o/2'] WHEN 1 THEN [url || '.pdf', url] ELSE ['http://o/2.pdf', 'http://o/2'] END, ' ') AS urls, url || '.pdf' AS first FROM pages")
def open_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """direct links before landing pages, each once; the first link declared as PDF."""
    id, place = F.col("page_id"), "struct<url_for_pdf:string,url:string>"
    own = F.struct(F.concat(F.col("url"), F.lit(".pdf")).alias("url_for_pdf"), F.col("url").alias("url"))
    other = F.struct(F.lit("http://o/2.pdf").alias("url_for_pdf"), F.lit("http://o/2").alias("url"))
    best = F.when(id % 3 < 2, own).cast(place)
    others = F.when(id % 3 == 1, F.array(own)).otherwise(F.array(other, other))
    links = F.array(F.struct(F.lit("text/html").alias("content_type"), F.col("url").alias("url")), F.struct(F.lit("application/pdf").alias("content_type"), F.concat(F.col("url"), F.lit(".pdf")).alias("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.open_urls(best, others), " ").alias("urls"), X.first_pdf_link(links).alias("first"))


@query("conversation_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user' DESC, turn)::INT AS place FROM conversations")
def conversation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a flag first, then the order there was."""
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "user"), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(order).alias("place"))
