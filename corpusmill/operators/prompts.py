"""Prompts for an injected judge, as columns; the passage comes first, so that prompts over one passage share a prefix.

The wording is this library's own, so hashes of prompts tell its own prompts apart and equal those of no other tool.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import abstracts, prompt, prompt_hash
from ..schemas import CRITERIA
from .judging import AGREEMENT

QUESTIONS = {
    "two_worlds": "Does the passage argue that the system joins two independent kinds of objects?",
    "adaptors": "Does the passage argue that molecules of a third kind make the connection, each bound to both sides?",
    "arbitrariness": "Does the passage argue that the rules of the connection could have been others?",
}
#: Criteria for which the judge first states the best case for the contrary.
CONTRARY_FIRST = ("arbitrariness",)
SYSTEM = "You judge what a passage itself argues. Quote it word for word. Answer with one JSON object and nothing else."


def graded_schema() -> str:
    """Shape of a graded reply as JSON schema."""
    kinds = {"agreement": {"enum": list(AGREEMENT)}, "confidence": {"enum": ["low", "medium", "high"]}, "evidence_quote": {"type": "string"}, "reasoning": {"type": "string"}}
    return json.dumps({"type": "object", "properties": kinds, "required": list(kinds)})


def template(criterion: str) -> str:
    """What a prompt about a criterion says around its passage."""
    contrary = "First state the best case for the contrary." if criterion in CONTRARY_FIRST else ""
    return "\n".join(x for x in (QUESTIONS[criterion], contrary, "Reply in this shape: " + graded_schema()) if x)


def chunk_prompt(passage: Column, criterion: str, topic: Column, blurb: Column, examples: list[str] | None = None) -> Column:
    """passage, topic, worked examples and the question about one criterion."""
    about = F.when(topic.isNotNull(), F.concat(F.lit("Topic: "), topic, F.coalesce(F.concat(F.lit(". "), blurb), F.lit(""))))
    shown = [F.lit(f"Example of agreement: {x}") for x in examples or []]
    return prompt([F.concat(F.lit("Passage:\n"), passage), about, *shown, F.lit(template(criterion))])


def paper_prompt(text: Column, criteria: tuple[str, ...] = CRITERIA) -> Column:
    """one prompt about several criteria of a paper."""
    asked = "\n".join(f"{c}: {QUESTIONS[c]}" for c in criteria)
    shape = 'Reply with an object that has for each criterion {"verdict": "met" | "not_met" | "unclear", "confidence": 0..1, "evidence_quote": "", "reasoning": ""}.'
    return prompt([F.concat(F.lit("Paper:\n"), text), F.lit(asked), F.lit(shape)])


def exclusion_prompt(passage: Column) -> Column:
    """asks for what a passage says is no code."""
    return prompt([F.concat(F.lit("Passage:\n"), passage), F.lit('List what the passage says does not qualify: {"exclusions": [{"candidate": "", "quote": "", "reasoning": ""}]}.')])


def registry(df: DataFrame) -> DataFrame:
    """K7: ``(prompt_hash, criterion, template)`` for each criterion of ``df(criterion)``."""
    known = F.create_map(*[x for c in CRITERIA for x in (F.lit(c), F.lit(template(c)))])
    rows = df.select("criterion").distinct().withColumn("template", F.try_element_at(known, F.col("criterion"))).where("template is not null")
    return rows.select(prompt_hash(F.col("template")).alias("prompt_hash"), "criterion", "template")


def work_list(windows: DataFrame, done: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Cells (window and criterion) that no checkpoint has, with their prompts: ``windows(pdf_path, chunk_idx, text, topic, blurb)``."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), chunk_prompt(F.col("text"), c, F.col("topic"), F.col("blurb")).alias("prompt"), F.sha2(F.lit(template(c)), 256).alias("prompt_hash")) for c in criteria]))
    rows = windows.select("*", cells.alias("c")).select(*windows.columns, "c.*").withColumn("system", F.lit(SYSTEM))
    return rows.join(done.select("pdf_path", "chunk_idx", "criterion").distinct(), ["pdf_path", "chunk_idx", "criterion"], "left_anti")


def payload(papers: DataFrame, max_chars: int) -> DataFrame:
    """``(pdf_path, full, abstract)``: the text up to a length, and its abstract."""
    short = abstracts(papers.select("pdf_path", "text"), "pdf_path", "text")
    return papers.select("pdf_path", F.left("text", F.lit(max_chars)).alias("full")).join(short, "pdf_path")
