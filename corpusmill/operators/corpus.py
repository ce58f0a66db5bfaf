"""Selection of papers: pools, samples, resumable work lists and what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the least values of ``order``; an aggregate with map-side combine, so no key is gathered.

    Rows that tie in the order are told apart by their other columns, the least first.
    """
    return _picked(df, key, F.min, order)


def last_by(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The last row of each key, as where later rows overwrite earlier ones."""
    return _picked(df, key, F.max, [position])


def _picked(df: DataFrame, key: list[str], pick: Callable[[Column], Column], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*key, *order)]
    best = df.groupBy(*key).agg(pick(F.struct(*order, *rest)).alias("picked"))
    return best.select(*[F.col(c) if c in key else F.col("picked").getField(c).alias(c) for c in df.columns])


def pool(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations whose paper is on disk, the first of each path."""
    return first_by(citations.join(files.select("pdf_path").distinct(), "pdf_path", "left_semi"), ["pdf_path"], ["position"])


def merge_corpus(labelled: DataFrame, extra: DataFrame) -> DataFrame:
    """Labelled papers, and those of the pool that are new."""
    new = extra.join(labelled.select("pdf_path").distinct(), "pdf_path", "left_anti").dropDuplicates(["pdf_path"])
    return labelled.unionByName(new.select(*labelled.columns))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0, existing: DataFrame | None = None) -> DataFrame:
    """T5: ``n`` rows (none for a negative n) in an order that the seed decides, without keys that exist."""
    rows = df if existing is None else df.join(existing.select(key).distinct(), key, "left_anti")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(max(0, n))


def unjudged(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Distinct papers with scores but without a verdict of their code and path."""
    return scores.join(verdicts, ["code_number", "pdf_path"], "left_anti").select("pdf_path").distinct()


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def found_and_missing(papers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers that are wanted, and wanted paths without a paper."""
    paths = wanted.select("pdf_path").distinct()
    return papers.join(paths, "pdf_path", "left_semi"), paths.join(papers, "pdf_path", "left_anti")


def selected(dominants: DataFrame, wanted: DataFrame, n: int = 0) -> DataFrame:
    """Papers with a dominant topic among those wanted, in order; the first ``n`` where n is above 0."""
    rows = dominants.where("topic_id is not null").join(wanted.select("pdf_path").distinct(), "pdf_path", "left_semi").orderBy("pdf_path")
    return rows.limit(n) if n > 0 else rows


def without_self_references(doc_vectors: DataFrame, is_self: Column) -> tuple[DataFrame, DataFrame]:
    """Vectors that are kept, and paths that are dropped, in order."""
    return doc_vectors.where(~is_self), doc_vectors.where(is_self).select("pdf_path").distinct().orderBy("pdf_path")


def seminal_files(manifest: DataFrame, extra: list[str], files: DataFrame) -> DataFrame:
    """File names of the manifest and ``extra`` ones, each once in its first place, that are on disk."""
    spark = manifest.sparkSession
    more = spark.createDataFrame([(n, 1 << 40 | i) for i, n in enumerate(extra)], "name string, position long")
    listed = manifest.select(F.trim("source_file").alias("name"), F.col("position").cast("long")).unionByName(more).where("name <> ''")
    return first_by(listed, ["name"], ["position"]).join(files.select(F.col("basename").alias("name")), "name", "left_semi").orderBy("position")


def rows_to_append(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest entries whose link, or name without one, no row of code 0 has yet, each once."""
    key = F.coalesce(F.when(F.trim("url") != "", F.trim("url")), F.trim("paper_name"))
    have = existing.where("code_number = 0").select(key.alias("__k")).distinct()
    return first_by(manifest.withColumn("__k", key).join(have, "__k", "left_anti"), ["__k"], ["position"]).drop("__k")


def download_counts(rows: DataFrame) -> DataFrame:
    """Unique, duplicate, downloaded and failed rows of ``rows(path, position, ok)``; the first of a path counts."""
    paths = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "ok")).alias("first"))
    return paths.agg(
        F.count(F.lit(1)).alias("unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"), F.count_if("first.ok").alias("downloaded"), F.count_if(~F.col("first.ok")).alias("failed")
    )


def judged_count(verdicts: DataFrame) -> DataFrame:
    """Papers with a verdict."""
    return verdicts.where("verdict is not null").agg(F.count_distinct("pdf_path").alias("papers"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """File names of the manifest that the corpus folder lacks, to be copied."""
    return manifest.where("source_file <> ''").select("source_file").distinct().join(files.select(F.col("basename").alias("source_file")), "source_file", "left_anti")
