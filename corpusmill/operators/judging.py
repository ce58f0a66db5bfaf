"""The judge axis: replies parsed into verdicts, roll-ups from chunk to paper to code, and injected judges and encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_object
from ..schemas import CRITERIA, VERDICTS

#: Labels of graded replies.
AGREEMENT = {"strongly_disagree": -1.0, "disagree": -0.5, "neutral": 0.0, "agree": 0.5, "strongly_agree": 1.0}
CONFIDENCE = {"low": 0.33, "medium": 0.66, "high": 1.0}
#: Place of a verdict on the scale, and the band of scores that it owns.
ORDINAL = {"not_met": 0.0, "unclear": 0.5, "met": 1.0}
BANDS = {"not_met": (0.0, 0.33), "unclear": (0.34, 0.66), "met": (0.67, 1.0)}


def _chosen(key: Column, values: dict[str, float], default: Column) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), default)


def parse_verdicts(df: DataFrame, raw: str, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """A row for each criterion of a reply: verdict, confidence, evidence_quote, reasoning, and an error.

    Replies that cannot be read, or lack a criterion or a valid verdict, have the reason in ``error`` and no verdict.
    """
    schema = "map<string,struct<verdict:string,confidence:string,evidence_quote:string,reasoning:string>>"
    out = df.withColumn("__j", json_object(F.col(raw))).withColumn("__m", F.from_json("__j", schema))
    out = out.withColumn("criterion", F.explode(F.array(*[F.lit(c) for c in criteria]))).withColumn("__v", F.try_element_at("__m", F.col("criterion")))
    verdict = F.lower(F.col("__v.verdict"))
    error = F.when(F.col("__j").isNull(), F.lit("no JSON object")).when(F.col("__m").isNull() | (F.size("__m") == 0), F.lit("invalid JSON"))
    error = error.when(F.col("__v").isNull(), F.lit("missing criterion")).when(verdict.isNull(), F.lit("missing verdict")).when(~verdict.isin(*VERDICTS), F.lit("invalid verdict"))
    text = lambda n: F.coalesce(F.col(f"__v.{n}"), F.lit(""))
    return out.withColumns({
        "error": error, "verdict": F.when(error.isNull(), verdict), "confidence": F.coalesce(F.col("__v.confidence").try_cast("double"), F.lit(0.0)),
        "evidence_quote": text("evidence_quote"), "reasoning": text("reasoning"),
    }).drop("__j", "__m", "__v")


def parse_graded(df: DataFrame, raw: str) -> DataFrame:
    """agreement from -1 to 1 and confidence from the labels of a reply; unknown confidence is low, an unknown
    agreement an ``error``."""
    out = df.withColumn("__j", json_object(F.col(raw))).withColumn("__v", F.from_json("__j", "agreement string, confidence string, evidence_quote string, reasoning string"))
    agreement = _chosen(F.lower(F.trim("__v.agreement")), AGREEMENT, F.lit(None).cast("double"))
    error = F.when(F.col("__j").isNull(), F.lit("no JSON object")).when(F.col("__v.agreement").isNull(), F.lit("missing agreement")).when(agreement.isNull(), F.lit("invalid agreement"))
    return out.withColumns({
        "error": error, "agreement": agreement, "confidence": _chosen(F.lower(F.trim("__v.confidence")), CONFIDENCE, F.lit(CONFIDENCE["low"])),
        "evidence_quote": F.coalesce("__v.evidence_quote", F.lit("")), "reasoning": F.coalesce("__v.reasoning", F.lit("")),
    }).drop("__j", "__v")


def parse_exclusions(df: DataFrame, raw: str) -> DataFrame:
    """A row for each excluded candidate of a reply; items without a candidate and unreadable replies give none."""
    items = F.from_json(json_object(F.col(raw)), "exclusions array<struct<candidate:string,quote:string,reasoning:string>>")["exclusions"]
    rows = df.withColumn("__i", F.explode(items))
    clean = lambda n: F.trim(F.coalesce(F.col(f"__i.{n}"), F.lit("")))
    return rows.withColumns({n: clean(n) for n in ("candidate", "quote", "reasoning")}).where("candidate <> ''").drop("__i")


def verdict_ordinal(verdict: Column, unknown: float | None = 0.5) -> Column:
    """0, 0.5 or 1; what is unknown is ``unknown`` (0.5 for correlations, null for rankings)."""
    return _chosen(verdict, ORDINAL, F.lit(unknown).cast("double"))


def band_score(verdict: Column, e: Column) -> Column:
    """the verdict picks a band, the score from -1 to 1 a place in it; unknown verdicts have the band of unclear."""
    place = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e)) + 1) / 2
    low = _chosen(verdict, {k: a for k, (a, _) in BANDS.items()}, F.lit(BANDS["unclear"][0]))
    high = _chosen(verdict, {k: b for k, (_, b) in BANDS.items()}, F.lit(BANDS["unclear"][1]))
    return low + (high - low) * place


def coherence(df: DataFrame, first: str = "two_worlds", after: tuple[str, ...] = ("adaptors", "arbitrariness")) -> DataFrame:
    """over one column a criterion: what presupposes an unmet criterion is vacuous, and being met flags the paper."""
    unmet = F.col(first) == "not_met"
    flags = [F.when(unmet & (F.col(c) == "met"), F.lit(f"{c}=met but {first}=not_met")) for c in after]
    return df.withColumns({f"{c}_vacuous": F.coalesce(unmet & F.col(c).isNotNull(), F.lit(False)) for c in after} | {"flags": F.array_compact(F.array(*flags))})


def graded_rollup(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest and mean agreement, the confidence of the first chunk with the greatest, and the category."""
    top = F.max(F.struct("agreement", (-F.col("chunk_idx")).alias("place"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("t")
    out = chunks.groupBy(*keys).agg(top, F.avg("agreement").alias("graded_mean"), F.count(F.lit(1)).alias("n_chunks"))
    best = F.col("t.agreement")
    category = F.when(best >= 0.5, F.lit("met")).when(best <= 0, F.lit("not_met")).otherwise(F.lit("unclear"))
    return out.select(*keys, best.alias("graded_max"), "graded_mean", F.col("t.confidence").alias("confidence"), category.alias("verdict"), "n_chunks")


def code_support(verdicts: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Papers of a code, and how many of them meet all criteria; with the papers themselves."""
    met = F.count_if((F.col("verdict") == "met") & F.col("criterion").isin(*criteria))
    papers = verdicts.groupBy("code_number", "pdf_path").agg((met == len(criteria)).alias("qualifies"))
    return papers.groupBy("code_number").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("qualifies").alias("supported"), F.array_sort(F.collect_list(F.struct("pdf_path", "qualifies"))).alias("papers")
    )


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row with the least ``order``; an aggregate with map-side combine, so no key is gathered.

    ``order`` are values that grow towards the older rows; :func:`descending` turns one that shrinks.
    """
    names = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*names).alias("row"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col("best.row").getField(c).alias(c) for c in df.columns])


def descending(value: Column) -> Column:
    """A number or time that grows as ``value`` shrinks; nulls come last."""
    seconds = F.coalesce(-F.unix_micros(value.cast("timestamp")), F.lit((1 << 63) - 1))
    return seconds


def by_judge(verdicts: DataFrame, judge: str | None = None) -> DataFrame:
    """Verdicts of one judge, or without one the newest of each (paper, criterion)."""
    if judge is not None:
        return verdicts.where(F.col("model") == judge)
    return newest(verdicts, ["code_number", "pdf_path", "criterion"], [descending(F.col("run_ts")), F.col("model")])


def usage_cost(calls: DataFrame, by: list[str], fresh: float, cached: float, out: float, paper: str | None = None) -> DataFrame:
    """Calls and tokens summed, and their cost from prices of a million tokens; fresh tokens are never below 0.
    ``paper`` names the papers to be counted too."""
    papers = [F.count_distinct(paper).alias("papers")] if paper else []
    sums = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *papers, *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt", "cached", "completion", "reasoning")])
    cost = F.greatest(F.lit(0), F.col("prompt") - F.col("cached")) * fresh + F.col("cached") * cached + F.col("completion") * out
    return sums.withColumn("cost", cost / 1e6)


def extrapolated(cost: Column, papers: Column, total: int) -> Column:
    """What ``total`` papers would cost at the same price a paper; null without papers."""
    return F.try_divide(cost, papers) * total


def chunk_records(parsed: DataFrame, prompt_hash: Column) -> DataFrame:
    """Flat chunk records with the defaults of values from before the gate."""
    present = set(parsed.columns)
    keep = lambda n, default: F.coalesce(F.col(n), default) if n in present else default
    return parsed.select(
        "code_number", "pdf_path", "criterion", "chunk_idx", "agreement", "confidence", keep("evidence_quote", F.lit("")).alias("evidence_quote"), keep("reasoning", F.lit("")).alias("reasoning"),
        keep("raw_agreement", F.col("agreement")).alias("raw_agreement"), keep("coverage", F.lit(None).cast("double")).alias("coverage"), keep("grounding_failed", F.lit(False)).alias("grounding_failed"), prompt_hash.alias("prompt_hash"),
    )


def judge(work: DataFrame, complete: Callable[[str, str], str], parallel: int | None = None, workers: int = 6) -> DataFrame:
    """``work(system, prompt, ...)`` with the reply of an injected ``complete(system, prompt)`` in ``raw``.

    A task makes ``workers`` calls at once, and ``parallel`` spreads rows over that many tasks. A call that fails leaves its
    reason in ``call_error`` and does not touch other rows. The callable is sent to the executors and has to be picklable.
    """
    names = list(work.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def call(system: str, prompt: str) -> tuple[str | None, str | None]:
            try:
                return complete(system, prompt), None
            except Exception as error:  # noqa: BLE001  whatever the injected callable raises belongs to its row
                return None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                answers = list(pool.map(call, pdf["system"], pdf["prompt"]))
                yield pdf[names].assign(raw=[a for a, _ in answers], call_error=[e for _, e in answers])

    rows = work.repartition(parallel) if parallel else work
    return rows.mapInPandas(run, f"{work.schema.simpleString()[7:-1]}, raw string, call_error string")


def judge_and_keep(work: DataFrame, path: str, keys: list[str], complete: Callable[[str, str], str], rounds: int = 8, parallel: int | None = None, workers: int = 6) -> DataFrame:
    """Z2 with a checkpoint: replies to cells that ``path`` does not have yet are appended there, and all of it is returned.

    Cells are dealt by their keys into ``rounds``; each is written when it ends, so what a stopped run finished is kept and
    the next run goes on with the rest. Calls that failed are not written and come again then.
    """
    spark = work.sparkSession
    kind = T.StructType([*work.schema.fields, T.StructField("raw", T.StringType())])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i in range(rounds):
        todo = work.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == i)
        if fs.exists(hadoop):
            todo = todo.join(spark.read.schema(kind).json(path).select(*keys).distinct(), keys, "left_anti").select(*work.columns)
        judge(todo, complete, parallel, workers).where("call_error is null").drop("call_error").write.mode("append").json(path)
    return spark.read.schema(kind).json(path)


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """``texts`` with the vectors of an injected encoder in ``vec``."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encode([x or "" for x in s])])

    return texts.withColumn("vec", vectors(F.col(text)))


def hashing_encoder(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """An encoder for tests: signed word hashes added up."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return encode


def method_texts(papers: DataFrame, windows: Column, abstract: Column) -> DataFrame:
    """``(code_number, pdf_path, method, chunk_idx, text)`` of the full text, the abstract and the windows.

    A paper without text has no rows.
    """
    full = F.array(F.struct(F.lit("full").alias("method"), F.lit(0).alias("chunk_idx"), F.col("text").alias("text")), F.struct(F.lit("abstract").alias("method"), F.lit(0).alias("chunk_idx"), abstract.alias("text")))
    chunks = F.transform(windows, lambda w, i: F.struct(F.lit("chunk").alias("method"), i.alias("chunk_idx"), w.alias("text")))
    rows = papers.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("code_number", "pdf_path", F.explode(F.concat(full, chunks)).alias("x"))
    return rows.select("code_number", "pdf_path", "x.*").where(F.col("text") != "")
