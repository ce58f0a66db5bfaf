"""Queries of the judge path: replies parsed, gated and projected, with replies and quotes made from events and documents.

The Spark side builds replies as text and reads them again; the SQL says what they held, so it proves the parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grounding
from ..functions import text as X
from ..operators import gold, judging, prompts
from ..schemas import CRITERIA
from ..sources import readers, store
from .base import query, rounded, table, working_folder

_KINDS = ("MET", "not_met", "unclear")
_CRITERIA = "(VALUES (0, 'two_worlds'), (1, 'adaptors'), (2, 'arbitrariness')) AS c(i, criterion)"


def _reply(id: Column) -> Column:
    """Replies in seven shapes: plain, fenced, none, a criterion left out, a label that is none, broken, a verdict left out."""

    def part(i: int, verdict: Column) -> Column:
        return F.concat(F.lit(f'"{CRITERIA[i]}": {{'), verdict, F.lit('"confidence": 0.'), (id % 10).cast("string"), F.lit(', "evidence_quote": "q'), id.cast("string"), F.lit('", "reasoning": "because {so}"}'))

    kinds = F.array(*[F.lit(k) for k in _KINDS])
    verdict = lambda i: F.concat(F.lit('"verdict": "'), F.element_at(kinds, ((id + i) % 3 + 1).cast("int")), F.lit('", '))
    whole = F.concat(F.lit("{"), part(0, verdict(0)), F.lit(", "), part(1, verdict(1)), F.lit(", "), part(2, verdict(2)), F.lit("}"))
    two = F.concat(F.lit("{"), part(0, verdict(0)), F.lit(", "), part(2, verdict(2)), F.lit("}"))
    odd = F.concat(F.lit("{"), part(0, F.lit('"verdict": "maybe", ')), F.lit(", "), part(1, verdict(1)), F.lit(", "), part(2, verdict(2)), F.lit("}"))
    less = F.concat(F.lit("{"), part(0, verdict(0)), F.lit(", "), part(1, verdict(1)), F.lit(", "), part(2, F.lit("")), F.lit("}"))
    shape = id % 7
    return (
        F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nand {no} more"))).when(shape == 2, "I cannot say.")
        .when(shape == 3, F.concat(F.lit("So: "), two)).when(shape == 4, odd).when(shape == 5, '{"two_worlds": oh }').otherwise(less)
    )


_PARSED = f"""WITH p AS (SELECT event_id, c.i, c.criterion, event_id % 7 AS shape, CASE event_id % 7 WHEN 2 THEN 'no JSON object' WHEN 5 THEN 'invalid JSON' WHEN 3 THEN CASE c.i WHEN 1 THEN 'missing criterion' END
 WHEN 4 THEN CASE c.i WHEN 0 THEN 'invalid verdict' END WHEN 6 THEN CASE c.i WHEN 2 THEN 'missing verdict' END END AS error FROM events, {_CRITERIA}),
r AS (SELECT event_id, criterion, error, CASE WHEN error IS NULL THEN ['met', 'not_met', 'unclear'][(event_id + i) % 3 + 1] END AS verdict, shape IN (2, 5) OR coalesce(error = 'missing criterion', false) AS void FROM p)"""


@query("parsed_verdicts", f"{_PARSED} SELECT event_id, criterion, error, verdict, CASE WHEN void THEN 0.0 ELSE (event_id % 10) / 10.0 END::DOUBLE AS confidence, CASE WHEN void THEN '' ELSE 'q' || event_id END AS evidence_quote, CASE WHEN void THEN '' ELSE 'because {{so}}' END AS reasoning FROM r".replace("{{so}}", "{so}"))
def parsed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "events").select("event_id", _reply(F.col("event_id")).alias("raw"))
    return judging.parse_verdicts(replies, "raw").drop("raw")


@query("json_replies", "SELECT event_id, event_id % 7 <> 2 AS has_object, CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 3 ELSE 0 END::INT AS n_criteria FROM events")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.json_object(_reply(F.col("event_id")))
    n = F.coalesce(F.size(F.from_json(found, "map<string,struct<confidence:double>>")), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", found.isNotNull().alias("has_object"), F.greatest(n, F.lit(0)).alias("n_criteria"))


def _graded_reply(id: Column) -> Column:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    agreement = pick([" Strongly_Disagree ", "disagree", "neutral", "agree", "STRONGLY_AGREE", "whatever"], id % 6)
    confidence = pick(["low", "Medium ", "high", "certain"], id % 4)
    body = F.concat(F.lit('{"agreement": "'), agreement, F.lit('", "confidence": "'), confidence, F.lit('", "evidence_quote": "q'), id.cast("string"), F.lit('"}'))
    return F.when(id % 11 == 0, "no idea").when(id % 13 == 0, '{"confidence": "high"}').otherwise(F.concat(F.lit("```json\n"), body, F.lit("```")))


_GRADED_SQL = """g AS (SELECT event_id, event_id % 11 = 0 AS none, event_id % 11 <> 0 AND event_id % 13 = 0 AS bare FROM events),
p AS (SELECT event_id, CASE WHEN none THEN 'no JSON object' WHEN bare THEN 'missing agreement' WHEN event_id % 6 = 5 THEN 'invalid agreement' END AS error,
CASE WHEN NOT none AND NOT bare AND event_id % 6 < 5 THEN (event_id % 6 - 2) / 2.0 END::DOUBLE AS agreement, CASE WHEN none THEN 0.33 WHEN bare THEN 1.0 ELSE [0.33, 0.66, 1.0, 0.33][event_id % 4 + 1] END::DOUBLE AS confidence,
CASE WHEN none OR bare THEN '' ELSE 'q' || event_id END AS evidence_quote, '' AS reasoning FROM g)"""


@query("parsed_graded", f"WITH {_GRADED_SQL} SELECT event_id, error, agreement, confidence, evidence_quote, reasoning FROM p")
def parsed_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.parse_graded(table(spark, sf_dir, "events").select("event_id", _graded_reply(F.col("event_id")).alias("raw")), "raw").drop("raw")


@query("parsed_exclusions", """SELECT c_custkey, x.candidate, x.quote, '' AS reasoning FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN [{candidate: 'code ' || c_custkey, quote: 'is "none"'}]
 WHEN 1 THEN [{candidate: 'one', quote: c_name}, {candidate: 'two', quote: ''}] ELSE [] END) AS x FROM customer)""")
def parsed_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    one = F.concat(F.lit('{"exclusions": [{"candidate": " code '), key.cast("string"), F.lit(' ", "quote": "is \\"none\\"", "reasoning": ""}, {"candidate": "  ", "quote": "x"}]}'))
    two = F.concat(F.lit('```{"exclusions": [{"candidate": "one", "quote": "'), F.col("c_name"), F.lit('"}, {"candidate": "two"}]}```'))
    reply = F.when(key % 4 == 0, one).when(key % 4 == 1, two).when(key % 4 == 2, '{"exclusions": []}').otherwise("nothing")
    return judging.parse_exclusions(table(spark, sf_dir, "customer").select("c_custkey", reply.alias("raw")), "raw").select("c_custkey", "candidate", "quote", "reasoning")


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quote: their text, the text in other case and spacing, something made up, or a blank."""
    id, passage = F.col("doc_id"), F.replace("text", F.lit("ß"), F.lit("ss"))
    quote = F.when(id % 4 == 0, passage).when(id % 4 == 1, F.replace(F.upper(passage), F.lit(" "), F.lit("   "))).when(id % 4 == 2, F.concat(F.lit("0123456789 9876543210 0246813579 "), id.cast("string"))).otherwise(" ")
    verdict = F.element_at(F.array(F.lit("met"), F.lit("unclear"), F.lit("not_met")), (id % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", passage.alias("passage"), quote.alias("evidence_quote"), ((id % 5 - 2) / 2).alias("agreement"), verdict.alias("verdict"))


#: SQL of what is grounded among these; a text without words grounds nothing.
_HELD = "(doc_id % 4 < 2 AND regexp_matches(text, '[^\\s]'))"


@query("gated_verdicts", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND {_HELD} THEN 'met' WHEN doc_id % 3 < 2 THEN 'unclear' ELSE 'not_met' END AS verdict, doc_id % 3 = 0 AND NOT {_HELD} AS grounding_failed FROM documents")
def gated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.gate_verdicts(_quoted(spark, sf_dir)).select("doc_id", "verdict", "grounding_failed")


_GATED = f"""g AS (SELECT doc_id, (doc_id % 5 - 2) / 2.0::DOUBLE AS raw_agreement, {_HELD} AS grounded FROM documents),
z AS (SELECT doc_id, raw_agreement, raw_agreement > 0 AND NOT grounded AS grounding_failed, grounded, CASE WHEN raw_agreement > 0 AND NOT grounded THEN 0.0 ELSE raw_agreement END::DOUBLE AS agreement FROM g)"""


@query("gated_graded", f"WITH {_GATED} SELECT doc_id, raw_agreement, agreement, grounding_failed, CASE WHEN grounded THEN true END AS well_covered FROM z")
def gated_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grounding.gate_graded(_quoted(spark, sf_dir))
    return out.select("doc_id", "raw_agreement", "agreement", "grounding_failed", F.when(F.col("coverage") >= grounding.TAU, True).alias("well_covered"))


@query("grounded_items", f"SELECT doc_id FROM documents WHERE {_HELD}")
def grounded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.ground_items(_quoted(spark, sf_dir), "evidence_quote").select("doc_id")


@query("zeroed_with_quote", f"WITH {_GATED} SELECT doc_id, 'j' || (doc_id % 3) AS model FROM z JOIN documents USING (doc_id) WHERE agreement = 0 AND doc_id % 4 <> 3 AND (doc_id % 4 = 2 OR grounded) AND doc_id % 3 < 2")
def zeroed_with_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of some judges that came to 0 although they quote something."""
    cells = grounding.gate_graded(_quoted(spark, sf_dir)).withColumn("model", F.concat(F.lit("j"), (F.col("doc_id") % 3).cast("string")))
    return store.zeroed_with_quote(cells, ["j0", "j1"]).select("doc_id", "model")


@query("chunk_records", f"WITH {_GATED} SELECT doc_id % 10 AS code_number, 'doc/' || doc_id AS pdf_path, 'adaptors' AS criterion, 0 AS chunk_idx, agreement, NULL::DOUBLE AS confidence, raw_agreement, grounding_failed, '' AS reasoning, sha256('t') AS prompt_hash FROM z")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = grounding.gate_graded(_quoted(spark, sf_dir))
    cells = gated.select((F.col("doc_id") % 10).alias("code_number"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pdf_path"), F.lit("adaptors").alias("criterion"), F.lit(0).alias("chunk_idx"), F.lit(None).cast("double").alias("confidence"), "agreement", "raw_agreement", "coverage", "grounding_failed", "evidence_quote")
    return judging.chunk_records(cells, F.sha2(F.lit("t"), 256)).drop("coverage", "evidence_quote")


@query("chunk_record_defaults", "SELECT event_id, '' AS evidence_quote, value AS raw_agreement, NULL::DOUBLE AS coverage, false AS grounding_failed FROM events")
def chunk_record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13 for cells from before the gate."""
    cells = table(spark, sf_dir, "events").select(F.lit(1).alias("code_number"), F.lit("p").alias("pdf_path"), F.lit("c").alias("criterion"), F.col("event_id").alias("chunk_idx"), F.col("value").alias("agreement"), F.lit(1.0).alias("confidence"))
    return judging.chunk_records(cells, F.lit("h")).select(F.col("chunk_idx").alias("event_id"), "evidence_quote", "raw_agreement", "coverage", "grounding_failed")


@query("cost_per_paper", """WITH s AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS papers, (greatest(0, sum(l_quantity) - sum(l_linenumber)) * 0.5 + sum(l_linenumber) * 0.1 + sum(l_tax * 100) * 1.5) / 1e6 AS cost FROM lineitem GROUP BY ALL)
SELECT l_returnflag, papers, round(cost / papers * 471, 5) + 0.0 AS projected FROM s""")
def cost_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32 with the cost of a whole corpus at the same price a paper."""
    calls = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("cached"), (F.col("l_tax") * 100).alias("completion"), F.lit(0).alias("reasoning"))
    cost = judging.usage_cost(calls, ["l_returnflag"], 0.5, 0.1, 1.5, "l_orderkey")
    return cost.select("l_returnflag", "papers", rounded(judging.extrapolated(F.col("cost"), F.col("papers"), 471)).alias("projected"))


@query("verdicts_of_judge", "SELECT o_custkey, o_orderpriority AS criterion, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def verdicts_of_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.by_judge(_verdict_like(spark, sf_dir), "F").select(F.col("code_number").alias("o_custkey"), "criterion", "o_orderkey")


@query("newest_verdicts", "SELECT o_custkey, o_orderpriority AS criterion, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey) = 1")
def newest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.by_judge(_verdict_like(spark, sf_dir)).select(F.col("code_number").alias("o_custkey"), "criterion", "o_orderkey")


def _verdict_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("code_number"), F.lit("p").alias("pdf_path"), F.col("o_orderpriority").alias("criterion"), F.col("o_orderstatus").alias("model"), F.col("o_orderdate").alias("run_ts"), "o_orderkey")


@query("judged_papers", "SELECT count(DISTINCT user_id) AS papers FROM events WHERE event_type <> 'view'")
def judged_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.corpus import judged_count

    return judged_count(table(spark, sf_dir, "events").select(F.col("user_id").alias("pdf_path"), F.when(F.col("event_type") != "view", "met").alias("verdict")))


@query("work_cells", """SELECT doc_id AS pdf_path, c.criterion FROM documents, (VALUES ('two_worlds'), ('adaptors'), ('arbitrariness')) AS c(criterion) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR c.criterion <> 'adaptors'""")
def work_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no checkpoint has, with their prompts."""
    windows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_path"), F.lit(0).alias("chunk_idx"), "text", F.lit("t").alias("topic"), F.lit(None).cast("string").alias("blurb"))
    done = readers.done_keys(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("pdf_path"), F.lit(0).alias("chunk_idx"), F.lit("adaptors").alias("criterion")), ["pdf_path", "chunk_idx", "criterion"])
    return prompts.work_list(windows, done).where(F.contains("prompt", "text") & (F.length("prompt_hash") == 64)).select("pdf_path", "criterion")


@query("prompt_parts", "SELECT conv_id, turn, 'Passage:' || chr(10) || text || chr(10) || chr(10) || CASE WHEN role = 'user' THEN 'Topic: ' || role || '. blurb' || chr(10) || chr(10) ELSE '' END AS head FROM conversations")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the passage comes first, then the topic where there is one."""
    topic = F.when(F.col("role") == "user", F.col("role"))
    made = prompts.chunk_prompt(F.col("text"), "adaptors", topic, F.lit("blurb"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(made, F.lit(prompts.template("adaptors")), F.lit("")).alias("head"))


@query("prompt_registry", "SELECT c.criterion, 1 AS n FROM (VALUES ('two_worlds'), ('adaptors'), ('arbitrariness')) AS c(criterion)")
def prompt_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: each template once under its hash, whatever else is asked for."""
    asked = table(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(c) for c in (*CRITERIA, "other")]), (F.col("event_id") % 4 + 1).cast("int")).alias("criterion"))
    known = prompts.registry(asked).where(F.col("prompt_hash") == F.sha2("template", 256))
    return known.groupBy("criterion").agg(F.count_distinct("prompt_hash").cast("int").alias("n"))


@query("checkpoint_lines", "SELECT event_id, value FROM events WHERE event_id % 13 <> 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def checkpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some of them cut off or blank, read back for some papers only."""
    e, path = table(spark, sf_dir, "events"), working_folder(spark, "checkpoint")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("pdf_path"), "event_id", "value"))
    e.select(F.when(F.col("event_id") % 13 != 0, line).when(F.col("event_id") % 26 == 0, F.left(line, F.lit(20))).otherwise("").alias("value")).write.text(path)
    papers = e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("pdf_path"))
    return readers.read_checkpoint(spark, path, "pdf_path string, event_id long, value double", papers).select("event_id", "value")


@query("collected_exclusions", "SELECT c_custkey, x.candidate, x.quote FROM (SELECT c_custkey, unnest([{candidate: c_name, quote: c_mktsegment}, {candidate: 'b', quote: NULL}]) AS x FROM customer)")
def collected_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions of checkpoint lines, blank candidates passed over."""
    item = lambda candidate, quote: F.struct(candidate.alias("candidate"), quote.cast("string").alias("quote"), F.lit("").alias("reasoning"))
    items = F.array(item(F.col("c_name"), F.col("c_mktsegment")), item(F.lit(" "), F.lit("x")), item(F.lit("b"), F.lit(None)), item(F.lit(None).cast("string"), F.lit("y")))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pdf_path"), items.alias("exclusions"))
    return readers.collected_exclusions(lines).select(F.col("source_pdf").alias("c_custkey"), "candidate", "quote")


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as excluded candidates that map to a code, to one without papers or to none, and suppliers as papers."""
    c = table(spark, sf_dir, "customer")
    mapped = c.select(F.col("c_custkey").alias("item_no"), F.col("c_name").alias("candidate"), F.lit("q").alias("quote"), F.lit("r").alias("reasoning"), F.col("c_mktsegment").alias("source_pdf"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") * 2).alias("mapped_code"))
    s = table(spark, sf_dir, "supplier")
    papers = s.select(F.col("s_nationkey").alias("code_number"), F.col("s_name").alias("pdf_path"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code_number"), F.col("n_name").alias("code_name"))
    return mapped, papers, names


_EXCLUDED = """m AS (SELECT c_custkey AS item_no, c_name AS candidate, c_mktsegment AS source_pdf, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey * 2 END AS mapped_code FROM customer),
p AS (SELECT s_nationkey AS code_number, s_name AS pdf_path FROM supplier)"""


@query("exclusion_negatives", f"""WITH {_EXCLUDED} SELECT code_number, pdf_path, 'neg' AS polarity, 'hard' AS tier, 'exclusion' AS source, 'all' AS criterion, 'excluded ''' || arg_min(candidate, item_no) || ''': "q"' AS evidence
FROM p JOIN m ON mapped_code = code_number GROUP BY code_number, pdf_path""")
def exclusion_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, papers, _ = _mapped(spark, sf_dir)
    return gold.exclusion_negatives(mapped, papers)[0]


@query("conceptual_exclusions", f"WITH {_EXCLUDED} SELECT item_no FROM m WHERE mapped_code IS NULL OR mapped_code NOT IN (SELECT code_number FROM p)")
def conceptual_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, papers, _ = _mapped(spark, sf_dir)
    return gold.exclusion_negatives(mapped, papers)[1].select("item_no")


@query("exclusions_audit", f"""WITH {_EXCLUDED} SELECT source_pdf, candidate, n_nationkey AS mapped_code, n_name AS mapped_name, 'q' AS quote, 'r' AS reasoning FROM m LEFT JOIN (SELECT * FROM nation WHERE n_nationkey IN (SELECT code_number FROM p)) ON mapped_code = n_nationkey""")
def exclusions_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, papers, names = _mapped(spark, sf_dir)
    return gold.exclusions_audit(mapped, names, papers)


@query("exclude_phase", f"""WITH {_EXCLUDED}, g AS (SELECT code_number, pdf_path, CASE code_number % 4 WHEN 0 THEN 'pos' ELSE 'neg' END AS polarity FROM p)
SELECT code_number, pdf_path, polarity FROM g UNION ALL SELECT DISTINCT code_number, pdf_path, 'neg' FROM p JOIN m ON mapped_code = code_number WHERE pdf_path NOT IN (SELECT pdf_path FROM g WHERE polarity = 'pos')""")
def exclude_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratified negatives enter but for papers that are positives."""
    mapped, papers, _ = _mapped(spark, sf_dir)
    known = papers.select("code_number", "pdf_path", F.when(F.col("code_number") % 4 == 0, "pos").otherwise("neg").alias("polarity"), *[F.lit("x").alias(c) for c in ("tier", "source", "criterion", "evidence")])
    return gold.exclude_phase(known, mapped, papers, ratified=True).select("code_number", "pdf_path", "polarity")
