"""The ranking dataset, validation against gold, and comparisons of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import basename
from ..schemas import CRITERIA, VERDICTS
from .judging import verdict_ordinal


def wide_scores(scores: DataFrame, criteria: tuple[str, ...] = CRITERIA, value: str = "e") -> DataFrame:
    """One row a paper with a column for each criterion."""
    return scores.groupBy("code_number", "pdf_path").agg(*[F.max(F.when(F.col("criterion") == c, F.col(value))).alias(c) for c in criteria])


def report_rows(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores with their verdicts where there are any, on (code, path, criterion)."""
    v = verdicts.select("code_number", "pdf_path", "criterion", "verdict", "confidence")
    return scores.join(v, ["code_number", "pdf_path", "criterion"], "left")


def by_path(report: DataFrame) -> DataFrame:
    """J2 keyed by path alone: the first code of a path, and of each (path, method, criterion) the last code's score."""
    last = F.max_by(F.struct("e", "verdict", "confidence"), "code_number").alias("x")
    return report.groupBy("pdf_path", "method", "criterion").agg(F.min("code_number").alias("code_number"), last).select("pdf_path", "code_number", "method", "criterion", "x.*")


def ranking_dataset(scores: DataFrame, verdicts: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Scores as columns ``e_<criterion>``, verdicts (joined by path only) as ``v_<criterion>`` and their ordinals."""
    e = scores.groupBy("code_number", "pdf_path").agg(*[F.max(F.when(F.col("criterion") == c, F.col("e"))).alias(f"e_{c}") for c in criteria])
    v = verdicts.where(F.col("criterion").isin(*criteria)).groupBy("pdf_path").agg(*[F.max(F.when(F.col("criterion") == c, F.col("verdict"))).alias(f"v_{c}") for c in criteria])
    out = e.join(v, "pdf_path", "left")
    return out.withColumns({f"o_{c}": verdict_ordinal(F.col(f"v_{c}"), None) for c in criteria})


def with_citations(records: DataFrame, citations: DataFrame) -> DataFrame:
    """Code and paper names by the name of the file; blank where there is no citation. ``citations`` has one row a file."""
    known = citations.select("basename", "code_name", "paper_name")
    out = records.withColumn("basename", basename(F.col("pdf_path"))).join(known, "basename", "left")
    return out.withColumn("matched", F.col("paper_name").isNotNull()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("code_name", "paper_name")})


def with_topics(records: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics of each paper, an empty list where there are none."""
    return records.join(topics.select("pdf_path", "topics"), "pdf_path", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def ranked(records: DataFrame, source: str, metric: str, partition: list[str] | None = None, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Records with the ``metric`` over the criteria of ``source`` (e or o), ordered from the highest, nulls last."""
    value = stats.row_aggregate(F.array(*[F.col(f"{source}_{c}").cast("double") for c in criteria]), metric)
    out = records.withColumn("value", value)
    if partition:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc_nulls_last("value"), "pdf_path")))
    return out.orderBy(F.desc_nulls_last("value"), "code_number", "pdf_path")


def matching(records: DataFrame, query: str) -> DataFrame:
    """Records in whose names, code or topics the query occurs, in any case."""
    text = F.lower(F.concat_ws(" ", "code_name", "paper_name", F.col("code_number").cast("string"), F.array_join("topics", " ")))
    return records.where(text.contains(query.lower()))


def labelled_counts(records: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Papers, and those with any verdict or topic."""
    judged = F.array(*[F.col(f"v_{c}") for c in criteria])
    topics = F.count_if(F.size("topics") > 0) if "topics" in records.columns else F.lit(0)
    return records.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.exists(judged, lambda v: v.isNotNull())).alias("judged"), topics.alias("with_topics"))


def gold_pairs(report: DataFrame, gold: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Report rows of papers in the gold set, for its criterion or, where that is ``all``, for each."""
    each = F.when(F.col("criterion") == "all", F.array(*[F.lit(c) for c in criteria])).otherwise(F.array("criterion"))
    g = gold.select("pdf_path", "polarity", "tier", F.explode(each).alias("criterion"))
    return report.join(g, ["pdf_path", "criterion"]).withColumn("gold_pos", F.col("polarity") == "pos")


def gold_validation(pairs: DataFrame) -> DataFrame:
    """By criterion the AUC and rho of the scores and the confusion of the verdicts against gold."""
    ordinal = pairs.withColumn("__g", F.col("gold_pos").cast("double"))
    a = stats.auc(pairs, "e", "gold_pos", ["criterion"])
    r = stats.spearman(ordinal, "e", "__g", ["criterion"]).select("criterion", "rho")
    judged = pairs.where(F.col("verdict").isin(*VERDICTS)).withColumn("__p", F.col("verdict") == "met")
    c = stats.confusion(judged, "__p", "gold_pos", ["criterion"]).withColumnRenamed("n", "n_judged")
    return a.join(r, "criterion", "left").join(c, "criterion", "left")


def pooled_rho(report: DataFrame) -> DataFrame:
    """Rho of scores and verdict ordinals by criterion and method; rows without a verdict are left out."""
    return stats.spearman(report.withColumn("__o", F.when(F.col("verdict").isNotNull(), verdict_ordinal(F.col("verdict")))), "e", "__o", ["criterion", "method"])


def topic_rho(report: DataFrame, dominants: DataFrame, min_n: int = 10) -> DataFrame:
    """The same by dominant topic, for topics with ``min_n`` papers that have any verdict; the largest first."""
    rows = report.where("verdict is not null").join(dominants.select("pdf_path", "topic_id"), "pdf_path")
    sizes = rows.groupBy("topic_id").agg(F.count_distinct("pdf_path").alias("n_papers")).where(F.col("n_papers") >= min_n)
    rows = rows.join(sizes, "topic_id").withColumn("__o", verdict_ordinal(F.col("verdict")))
    return stats.spearman(rows, "e", "__o", ["topic_id", "n_papers", "criterion", "method"]).orderBy(F.desc("n_papers"), "topic_id", "criterion", "method")


def grid_rho(swept: DataFrame, verdicts: DataFrame, method: str) -> DataFrame:
    """Rho in each cell of a sweep by criterion."""
    v = verdicts.select("code_number", "pdf_path", "criterion", verdict_ordinal(F.col("verdict")).alias("__o"))
    rows = swept.where(F.col("method") == method).join(v, ["code_number", "pdf_path", "criterion"])
    return stats.spearman(rows, "e", "__o", ["criterion", "cell", "k", "strength"])


def best_cells(grid: DataFrame) -> DataFrame:
    """A24."""
    return stats.best_cell(grid, ["criterion"], "rho", "cell")


def compared(old: DataFrame, new: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """A18 for two sets of verdicts, side by side."""
    both = old.select("criterion", "verdict", F.lit("old").alias("side")).unionByName(new.select("criterion", "verdict", F.lit("new").alias("side")))
    return stats.categorical_distribution(both.where(F.col("criterion").isin(*criteria)), ["criterion", "side"], "verdict", list(VERDICTS))


def as_of(rows: DataFrame, by: list[str], time: str, value: Column, name: str) -> DataFrame:
    """The greatest ``value`` among a key's rows up to each row's time, equal times included; null before the first.

    One pass over the rows of a key in order of time; both sides of an as-of join are one table here, so nothing is joined.
    """
    return rows.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(time)))
