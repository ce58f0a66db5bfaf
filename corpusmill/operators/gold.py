"""Rules that derive a gold set, each owning its rows by ``source``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, reference_entries, sections, signature
from .topics import modal

COLUMNS = ("code_number", "pdf_path", "polarity", "tier", "source", "criterion", "evidence")
#: Names of codes whose papers anchor the molecular axis.
ANCHOR_NAME = r"(?i)genetic\s+code"


def _rows(df: DataFrame, polarity: str, tier: str, source: str, evidence: Column) -> DataFrame:
    return df.select("code_number", "pdf_path", F.lit(polarity).alias("polarity"), F.lit(tier).alias("tier"), F.lit(source).alias("source"), F.lit("all").alias("criterion"), evidence.alias("evidence"))


def anchor_papers(papers: DataFrame, names: DataFrame, pattern: str = ANCHOR_NAME) -> DataFrame:
    """papers of the codes whose names match."""
    return papers.join(names.where(F.col("code_name").rlike(pattern)).select("code_number"), "code_number", "left_semi")


def molecular_codes(papers: DataFrame, dominants: DataFrame, allowed: DataFrame) -> DataFrame:
    """G1: codes other than 0 whose modal dominant topic is allowed: ``(code_number, topic_id, n_papers)``."""
    joined = papers.where("code_number <> 0").join(dominants.select("pdf_path", "topic_id"), "pdf_path", "left")
    counts = papers.groupBy("code_number").agg(F.count(F.lit(1)).alias("n_papers"))
    topic = modal(joined, ["code_number"], "topic_id", "topic_id")
    return topic.join(allowed.select("topic_id").distinct(), "topic_id", "left_semi").join(counts, "code_number").select("code_number", "topic_id", "n_papers")


def tier2_positives(papers: DataFrame, molecular: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each paper of a molecular code."""
    rows = papers.join(molecular, "code_number").join(names, "code_number", "left").join(labels, "topic_id", "left")
    evidence = F.concat_ws(" ", F.lit("molecular:"), F.coalesce("code_name", F.lit("")), F.lit("; topic"), F.col("topic_id").cast("string"), F.coalesce("label", F.lit("")))
    return _rows(rows, "pos", "2", "db", evidence)


def foundational_positives(papers: DataFrame) -> DataFrame:
    """Papers of code 0."""
    return _rows(papers.where("code_number = 0"), "pos", "1", "code0", F.lit("foundational text"))


def implicit_negatives(papers: DataFrame, dominants: DataFrame, allowed: DataFrame, molecular: DataFrame, labels: DataFrame, labelled: DataFrame) -> DataFrame:
    """Papers with a dominant topic that is not allowed, of no molecular code, not code 0 and not labelled before."""
    members = papers.join(molecular, "code_number", "left_semi").select("pdf_path")
    rows = papers.where("code_number <> 0").join(members.unionByName(labelled.select("pdf_path")).distinct(), "pdf_path", "left_anti")
    rows = rows.join(dominants.select("pdf_path", "topic_id").where("topic_id is not null"), "pdf_path").join(allowed.select("topic_id"), "topic_id", "left_anti")
    rows = rows.join(labels.select("topic_id", "label"), "topic_id", "left")
    topic = F.col("topic_id").cast("string")
    return _rows(rows, "neg", "soft", "implicit", F.concat_ws(" ", F.lit("non-molecular: topic"), topic, F.coalesce("label", topic)))


def cited_signatures(docs: DataFrame, key: str = "pdf_path", text: str = "text") -> DataFrame:
    """Distinct ``(surname, year)`` of the entries in the reference sections of texts."""
    parts = sections(docs, key, text).where(F.col("section").isin("references", "bibliography"))
    best = parts.groupBy(key).agg(F.max_by("body", F.when(F.col("section") == "references", 1).otherwise(0)).alias("body"))
    signed = reference_entries(best, key, "body").select(signature(F.col("entry")).alias("s")).where("s is not null")
    return signed.select("s.surname", "s.year").distinct()


def promoted(gold: DataFrame, names: DataFrame, cited: DataFrame) -> DataFrame:
    """Tier-2 positives whose paper is cited become tier 1; rows promoted before are left as they are."""
    signed = names.select("pdf_path", signature(F.col("paper_name")).alias("__s")).where("__s is not null").dropDuplicates(["pdf_path"])
    signed = signed.select("pdf_path", F.col("__s.surname").alias("__n"), F.col("__s.year").alias("__y"))
    known = cited.select(F.col("surname").alias("__n"), F.col("year").alias("__y"), F.lit(True).alias("__cited")).distinct()
    rows = gold.join(signed, "pdf_path", "left").join(known, ["__n", "__y"], "left")
    rises = (F.col("source") == "db") & (F.col("polarity") == "pos") & F.coalesce("__cited", F.lit(False))
    note = F.concat_ws(" | ", F.when(F.coalesce("evidence", F.lit("")) != "", F.col("evidence")), F.concat_ws(" ", F.lit("cited:"), F.col("__n"), F.col("__y")))
    return rows.withColumns({
        "tier": F.when(rises, F.lit("1")).otherwise(F.col("tier")), "evidence": F.when(rises, note).otherwise(F.col("evidence")), "source": F.when(rises, F.lit("cite")).otherwise(F.col("source")),
    }).select(*COLUMNS)


def match_candidates(items: DataFrame, names: DataFrame, candidate: str = "candidate") -> DataFrame:
    """``items`` with ``mapped_code``, the lowest code whose name has the same telling words; null for none."""
    keys = names.withColumn("__k", content_tokens(F.col("code_name"))).where(F.size("__k") > 0).groupBy("__k").agg(F.min("code_number").alias("mapped_code"))
    return items.withColumn("__k", content_tokens(F.col(candidate))).join(keys, "__k", "left").drop("__k")


def exclusion_negatives(mapped: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hard negatives, one for each paper of a mapped code (by its first item), and the items left conceptual.

    The first item of a code is found before papers are joined, so no code pairs all its items with all its papers.
    """
    evidence = F.concat(F.lit("excluded '"), F.col("candidate"), F.lit("': \""), F.left("quote", F.lit(120)), F.lit('"'))
    first = mapped.groupBy(F.col("mapped_code").alias("code_number")).agg(F.min(F.struct("item_no", evidence.alias("e")))["e"].alias("__e"))
    rows = papers.select("code_number", "pdf_path").distinct().join(first, "code_number")
    codes = papers.select(F.col("code_number").alias("mapped_code")).distinct()
    return _rows(rows, "neg", "hard", "exclusion", F.col("__e")), mapped.join(codes, "mapped_code", "left_anti")


def exclusions_audit(mapped: DataFrame, names: DataFrame, papers: DataFrame) -> DataFrame:
    """Each grounded exclusion with the code that it maps to, where that has papers."""
    codes = papers.select("code_number").distinct().join(names, "code_number", "left").select(F.col("code_number").alias("mapped_code"), F.col("code_name").alias("mapped_name"))
    joined = mapped.join(codes, "mapped_code", "left").withColumn("mapped_code", F.when(F.col("mapped_name").isNotNull(), F.col("mapped_code")))
    return joined.select("source_pdf", "candidate", "mapped_code", "mapped_name", "quote", "reasoning")


def without_conflicts(negatives: DataFrame, gold: DataFrame) -> DataFrame:
    """Negatives whose paper is no positive yet."""
    return negatives.join(gold.where("polarity = 'pos'").select("pdf_path").distinct(), "pdf_path", "left_anti").select(*COLUMNS)


def merge(existing: DataFrame, new: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of ``sources`` give way to the new ones."""
    return existing.where(~F.col("source").isin(sources)).unionByName(new)


def of_polarity(gold: DataFrame, polarity: str = "all") -> DataFrame:
    """P11."""
    return gold if polarity == "all" else gold.where(F.col("polarity") == polarity)


def select_phase(gold: DataFrame, papers: DataFrame, dominants: DataFrame, allowed: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the selecting phase, which owns the sources ``db`` and ``code0``."""
    molecular = molecular_codes(papers, dominants, allowed)
    rows = tier2_positives(papers, molecular, names, labels).unionByName(foundational_positives(papers))
    return merge(gold, rows, ["db", "code0"])


def cite_phase(gold: DataFrame, names: DataFrame, docs: DataFrame, key: str = "pdf_path", text: str = "text") -> DataFrame:
    """The citing phase: tier-2 positives that the reference sections of ``docs`` cite become tier 1, of source ``cite``."""
    return promoted(gold, names, cited_signatures(docs, key, text))


def implicit_phase(gold: DataFrame, papers: DataFrame, dominants: DataFrame, allowed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the implicit phase, which owns the source ``implicit``."""
    molecular = molecular_codes(papers, dominants, allowed)
    labelled = gold.where("source <> 'implicit'")
    return merge(gold, implicit_negatives(papers, dominants, allowed, molecular, labels, labelled), ["implicit"])


def exclude_phase(gold: DataFrame, mapped: DataFrame, papers: DataFrame, ratified: bool = False) -> DataFrame:
    """Hard negatives enter the gold set only where they are ratified; else the phase is for the audit alone."""
    if not ratified:
        return gold
    rows, _ = exclusion_negatives(mapped, papers)
    return merge(gold, without_conflicts(rows, gold), ["exclusion"])
