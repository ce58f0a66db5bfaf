"""Queries over texts, links and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grounding
from ..functions import text as X
from ..operators import gold
from .base import query, rounded, table


@query("token_windows", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT doc_id, w, unnest(range(CASE WHEN n <= 64 THEN 1 ELSE ceil((n - 64) / 32.0)::BIGINT + 1 END)) AS i FROM n) SELECT doc_id, i::INT AS window_no, array_to_string(list_slice(w, i * 32 + 1, i * 32 + 64), ' ') AS window_text FROM s""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", X.whitespace_tokens(F.col("text")).alias("w"))
    windows = tokens.select("doc_id", F.posexplode(X.token_windows(F.col("w"), 64, 32)).alias("window_no", "w"))
    return windows.select("doc_id", "window_no", F.array_join("w", " ").alias("window_text"))


@query("prose_windows", """WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE trim(text) <> ''), s AS (SELECT doc_id, text, unnest(range(CASE WHEN n <= 1200 THEN 1 ELSE ceil((n - 1200) / 1000.0)::BIGINT + 1 END)) AS i FROM n)
SELECT doc_id, i::INT AS window_no, md5(substring(text, i * 1000 + 1, 1200)) AS window_md5 FROM s""")
def prose_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.prose_windows(F.col("text"), 1200, 200)).alias("window_no", "w"))
    return windows.select("doc_id", "window_no", F.md5("w").alias("window_md5"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and the benchmark's texts as quotes."""
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))


@query("quote_containment", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = grounding.paired(*_quotes(spark, sf_dir), [str])
    return pairs.where(F.contains("text", "quote")).select("doc_id", "item_id")


@query("quote_grounding")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with a run as long as F11 asks for; all other pairs are not grounded."""
    docs, quotes = _quotes(spark, sf_dir)
    pairs = grounding.paired(docs, quotes, [grounding.fold_marks]).withColumn("m", grounding.quote_coverage(F.col("quote"), F.col("text")))
    pairs = pairs.where("m.length > 0")
    return pairs.select("doc_id", "item_id", rounded("m.coverage").alias("coverage"), "m.longest", grounding.grounded(F.col("m")).alias("grounded"))


@query("gate_cost_tally")
def gate_cost_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every pair of a document and a quote; pairs without a common run pass neither gate and are only counted."""
    docs, quotes = _quotes(spark, sf_dir)
    model = (F.col("doc_id") % 3).cast("string").alias("model")
    near = grounding.paired(docs, quotes, [grounding.fold_marks, grounding.fold_spaces])
    near = near.select(model, F.col("quote").alias("evidence_quote"), F.col("text").alias("passage"))
    near = grounding.classify_cells(near).groupBy("model", "strict", "fuzzy", "newly_passes").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda strict, fuzzy, newly, n: F.struct(strict.alias("strict"), fuzzy.alias("fuzzy"), newly.alias("newly_passes"), n.alias("n"), F.lit("").alias("passage"))
    no = [F.lit(False)] * 3
    # what is near counts with its verdicts, and is taken from the cells that have none
    near = near.select("model", F.inline(F.array(cell(F.col("strict"), F.col("fuzzy"), F.col("newly_passes"), F.col("n")), cell(*no, -F.col("n")))))
    every = docs.groupBy(model, F.when(F.col("text").isNotNull(), "").alias("passage")).agg((F.count(F.lit(1)) * quotes.count()).alias("n"))
    rest = every.select("model", *[x.alias(c) for x, c in zip(no, ("strict", "fuzzy", "newly_passes"), strict=True)], "n", "passage")
    return grounding.gate_cost(near.unionByName(rest), ["model"], "n")


@query("abstracts", "SELECT doc_id, left(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 4000) AS abstract FROM documents")
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.abstracts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("token_budget", "SELECT doc_id, CASE WHEN floor(length(text) / 3.58) <= 300 THEN text ELSE left(text, 1074) END AS text FROM documents")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.within_budget(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 300)


@query("link_paths", r"""SELECT page_id, nullif(regexp_extract(url, '10\.\d{4,9}/[^\s?#"''<>]+'), '') AS doi, left(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 150) AS slug, contains(lower(url), 'example.org') AS is_self FROM pages""")
def link_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.doi(u).alias("doi"), X.url_slug(u).alias("slug"), X.self_reference(u, ["example.org"]).alias("is_self"))


@query("citation_meta", r"""SELECT page_id, nullif(regexp_extract(html, '(?i)<meta[^>]*citation_pdf_url[^>]*content\s*=\s*[''"]([^''"]+)', 1), '') AS link FROM pages""")
def citation_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.nullif_blank(X.citation_link(F.col("html"))).alias("link"))


@query("prompt_hashes", "SELECT conv_id, turn, sha256('Instruct: judge' || chr(10) || 'Query: ' || text) AS prompt_hash FROM conversations")
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.prompt_hash(X.query_text(F.lit("judge"), F.col("text"))).alias("prompt_hash"))


@query("text_measures", r"""SELECT doc_id, floor(length(text) / 3.58)::INT AS tokens, len(regexp_extract_all(text, '\(\d{4}[a-z]?\)'))::INT AS citations, CASE WHEN length(text) > 41 THEN left(text, 40) || '…' ELSE text END AS head FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(t).alias("tokens"), X.citation_count(t).alias("citations"), X.shortened(t).alias("head"))


@query("candidate_codes", """WITH k AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS k FROM part), c AS (SELECT k, min(p_partkey) AS mapped_code FROM k GROUP BY ALL)
SELECT p_partkey, mapped_code FROM k JOIN c USING (k)""")
def candidate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("code_number"), F.col("p_name").alias("code_name"))
    return gold.match_candidates(part.select("p_partkey", F.concat(F.lit("The "), F.upper("p_name")).alias("candidate")), names).select("p_partkey", "mapped_code")


@query("signatures", r"""WITH c AS (SELECT c_custkey, c_name || ' (' || (1900 + c_custkey % 250) || ')' AS t FROM customer) SELECT c_custkey, rtrim(lower(regexp_extract(t, '^\s*([A-Z][A-Za-zÀ-ÿ''’.-]*)', 1)), '.') AS surname, regexp_extract(t, '\b(1[89]\d\d|20\d\d)\b', 1) AS year FROM c WHERE regexp_matches(t, '\b(1[89]\d\d|20\d\d)\b')""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("c_name"), F.lit(" ("), (1900 + F.col("c_custkey") % 250).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.signature(name).alias("s")).where("s is not null").select("c_custkey", "s.*")


@query("conversation_runs", """WITH f AS (SELECT conv_id, turn, role, text, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND turn > min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f) SELECT conv_id, run::BIGINT AS run, role, count(*) AS n_turns, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM i GROUP BY ALL""")
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = (F.row_number().over(order) == 1) | ~F.col("role").eqNullSafe(F.lag("role").over(order))
    rows = table(spark, sf_dir, "conversations").withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    gathered = rows.groupBy("conv_id", "run", "role").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return gathered.select("conv_id", "run", "role", "n_turns", F.md5(F.array_join("l.text", " ")).alias("text_md5"))
