"""Readers of the inputs: CSV dimensions, JSON checkpoints, configuration, documents.

Every reader has a fixed schema. Where the first or last of several rows counts, ``position`` says which came first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, output_path
from ..operators.corpus import first_by, last_by

#: Headers of the CSV files.
CITATION_HEADERS = ["Code Number", "Code Name", "Paper Name", "URL"]
TOPIC_HEADERS = ["Topic #", "Label", "Centroid Text"]
ALLOWED_HEADERS = ["topic_id", "label", "molecular"]
GOLD_HEADERS = ["code_number", "pdf_path", "polarity", "tier", "source", "criterion", "evidence"]
MANIFEST_HEADERS = ["Source File", "Paper Name", "URL"]


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header and multi-line fields, by column name; missing columns are null. ``position`` follows the
    order of rows in a file."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    have = set(raw.columns)
    return raw.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns], F.monotonically_increasing_id().alias("position"))


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """``(code_number, code_name, paper_name, url, position)`` of rows with a link."""
    rows = read_csv(spark, path, CITATION_HEADERS)
    rows = rows.select(F.col("`Code Number`").alias("code_number"), F.col("`Code Name`").alias("code_name"), F.col("`Paper Name`").alias("paper_name"), F.trim("URL").alias("url"), "position")
    return rows.where("url <> ''")


def read_code_names(spark: SparkSession, path: str) -> DataFrame:
    """``(code_number, code_name)``, the first name of each number."""
    rows = read_csv(spark, path, CITATION_HEADERS[:2])
    rows = rows.select(F.trim("`Code Number`").try_cast("int").alias("code_number"), F.trim("`Code Name`").alias("code_name"), "position").where("code_number is not null")
    return first_by(rows, ["code_number"], ["position"]).drop("position")


def paper_names(citations: DataFrame, folder: str) -> DataFrame:
    """S3: ``(pdf_path, paper_name)``, the first name of each path that is not blank."""
    rows = citations.where(F.trim("paper_name") != "").select(output_path(F.col("url"), folder).alias("pdf_path"), F.trim("paper_name").alias("paper_name"), "position")
    return first_by(rows, ["pdf_path"], ["position"]).drop("position")


def citations_by_file(citations: DataFrame, folder: str) -> DataFrame:
    """Citation by the name of its file; later rows win."""
    return last_by(citations.withColumn("basename", basename(output_path(F.col("url"), folder))), ["basename"], "position")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``(topic_id, label, centroid_text)``."""
    rows = read_csv(spark, path, TOPIC_HEADERS)
    return rows.select(F.trim("`Topic #`").try_cast("int").alias("topic_id"), F.trim("Label").alias("label"), F.trim("`Centroid Text`").alias("centroid_text")).where("topic_id is not null")


def read_centroid_texts(spark: SparkSession, path: str) -> DataFrame:
    """Topics that have a centroid text."""
    return read_topics(spark, path).where("centroid_text <> ''")


def read_topic_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(topic_id, label)`` of all rows with a number."""
    rows = read_csv(spark, path, ALLOWED_HEADERS[:2])
    return rows.select(F.trim("topic_id").try_cast("int").alias("topic_id"), F.trim("label").alias("label")).where("topic_id is not null")


def read_allowed_topics(spark: SparkSession, path: str) -> DataFrame:
    """``(topic_id, label)`` of topics marked yes."""
    rows = read_csv(spark, path, ALLOWED_HEADERS).where(F.lower(F.trim("molecular")) == "yes")
    return rows.select(F.trim("topic_id").try_cast("int").alias("topic_id"), F.trim("label").alias("label")).where("topic_id is not null")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold set; no rows where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "code_number int, " + ", ".join(f"{c} string" for c in GOLD_HEADERS[1:]))
    return read_csv(spark, path, GOLD_HEADERS).drop("position").withColumn("code_number", F.col("code_number").try_cast("int"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, paper_name, url, position)``."""
    rows = read_csv(spark, path, MANIFEST_HEADERS)
    clean = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    return rows.select(clean("Source File").alias("source_file"), clean("Paper Name").alias("paper_name"), clean("URL").alias("url"), "position")


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a malformed one is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_checkpoint(spark: SparkSession, path: str, schema: str, papers: DataFrame | None = None) -> DataFrame:
    """JSON lines, malformed ones passed over; only those of ``papers(pdf_path)`` where given."""
    fields = T.StructType.fromDDL(schema)
    rows = spark.read.schema(T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])).json(path, columnNameOfCorruptRecord="_corrupt")
    rows = rows.where("_corrupt is null").drop("_corrupt")
    return rows if papers is None else rows.join(papers.select("pdf_path").distinct(), "pdf_path", "left_semi")


def done_keys(checkpoint: DataFrame, keys: list[str]) -> DataFrame:
    """S13 (by paper), S14 (by paper, chunk and criterion), S15 (by window): what a checkpoint has."""
    return checkpoint.select(*keys).distinct()


def collected_exclusions(checkpoint: DataFrame) -> DataFrame:
    """The exclusions of checkpoint lines with a candidate, and where they came from."""
    rows = checkpoint.select(F.col("pdf_path").alias("source_pdf"), F.explode("exclusions").alias("x"))
    return rows.select("source_pdf", "x.candidate", "x.quote", "x.reasoning").where(F.trim(F.coalesce("candidate", F.lit(""))) != "")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``(pdf_path, criterion, verdict)`` of a snapshot."""
    return spark.read.schema("pdf_path string, criterion string, verdict string").json(path)


def load_prototypes(spark: SparkSession, path: str) -> dict:
    """Passages of the poles and instructions by criterion, from one JSON object in any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def prototype_passages(spark: SparkSession, prototypes: dict) -> DataFrame:
    """S18 as ``(criterion, pole, passage_no, text)``."""
    rows = [(c, pole, i, t) for c, p in prototypes.items() if isinstance(p, dict) for pole in ("pos", "neg") for i, t in enumerate(p.get(pole, []))]
    return spark.createDataFrame(rows, "criterion string, pole string, passage_no int, text string")


def read_cache(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``(key, value)`` of a JSON object; no rows where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def load_env(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines of a file; the process's own environment wins unless ``override``."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("'\"")
    return out if override else {k: os.environ.get(k, v) for k, v in out.items()}


def read_documents(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """``(pdf_path, text)`` of binary files; ``extract`` turns bytes into text, UTF-8 by default.

    Files are read by executors, one a row; a file that cannot be read has a null text.
    """
    def default(data: bytes) -> str:
        return data.decode("utf-8", "replace")

    turn = extract or default

    @F.pandas_udf(T.StringType())
    def text(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            try:
                out.append(turn(data))
            except Exception:  # noqa: BLE001  a bad file must not stop the others
                out.append(None)
        return pd.Series(out)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("pdf_path"), text("content").alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of files under a folder, for semi joins: ``(pdf_path, basename)``."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.select(F.col("path").alias("pdf_path"), basename(F.col("path")).alias("basename"))
