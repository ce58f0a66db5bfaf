"""Schemas and keys of the thirteen stored tables; keys are kept by the upserts of ``sources.store``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

CRITERIA = ("two_worlds", "adaptors", "arbitrariness")
METHODS = ("full", "abstract", "chunk")
VERDICTS = ("met", "not_met", "unclear")


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the key, and the column that partitions the files (a run or a judge)."""

    ddl: str
    key: tuple[str, ...]
    partition: str | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


TABLES: dict[str, Table] = {
    "embedding_scores": Table("run string, code_number int, pdf_path string, method string, criterion string, e double, model string, run_ts timestamp", ("run", "code_number", "pdf_path", "method", "criterion"), "run"),
    "verdicts": Table("code_number int, pdf_path string, criterion string, model string, verdict string, confidence double, graded double, prompt_hash string, run_ts timestamp", ("code_number", "pdf_path", "criterion", "model"), "model"),
    "chunk_verdicts": Table("code_number int, pdf_path string, criterion string, chunk_idx int, model string, agreement double, confidence double, evidence_quote string, raw_agreement double, coverage double, grounding_failed boolean, prompt_hash string, run_ts timestamp", ("code_number", "pdf_path", "criterion", "chunk_idx", "model"), "model"),
    "prompt_registry": Table("prompt_hash string, criterion string, template string, registered_ts timestamp", ("prompt_hash",)),
    "control_scores": Table("run string, name string, criterion string, e double, run_ts timestamp", ("run", "name", "criterion"), "run"),
    "pole_separation": Table("run string, pole string, pair string, cosine double, run_ts timestamp", ("run", "pole", "pair"), "run"),
    "run_meta": Table("run string, k string, v string", ("run", "k"), "run"),
    "doc_vectors": Table("run string, code_number int, pdf_path string, method string, chunk_idx int, vec array<float>", ("run", "code_number", "pdf_path", "method", "chunk_idx"), "run"),
    "control_vectors": Table("run string, name string, vec array<float>", ("run", "name"), "run"),
    "pole_vectors": Table("run string, criterion string, pole string, vec array<float>", ("run", "criterion", "pole"), "run"),
    "topic_centroids": Table("run string, topic_id int, label string, vec array<float>", ("run", "topic_id"), "run"),
    "gold_labels": Table("code_number int, pdf_path string, polarity string, tier string, source string, criterion string, evidence string", ("code_number", "pdf_path", "polarity", "criterion")),
    "chunk_topics": Table("run string, code_number int, pdf_path string, method string, chunk_idx int, topic_id int, similarity double", ("run", "code_number", "pdf_path", "method", "chunk_idx"), "run"),
}
