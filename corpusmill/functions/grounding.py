"""Grounding of quotes in passages: how much of a quote is drawn from its source, and gates over that."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least share of a quote that its source has to hold, and least length of one run of it.
TAU, MIN_BLOCK = 0.85, 15
#: Characters of quotes that may be collected and sent to every task.
MOST_CHARS = 1 << 26
#: Typographic variants and what they stand for.
PUNCTUATION = {"‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‒": "-", "‐": "-", "‑": "-", "−": "-", "­": ""}
_FOLD = str.maketrans(PUNCTUATION)


def fold_spaces(s: str) -> str:
    """F8: compatibility forms resolved, white space collapsed, lower case."""
    return " ".join(unicodedata.normalize("NFKC", s).split()).lower()


def fold_marks(s: str) -> str:
    """quotes and dashes folded too; hyphens and the white space behind them go, as hyphenation at line ends does."""
    return " ".join(re.sub(r"-\s*", "", unicodedata.normalize("NFKC", s).translate(_FOLD)).split()).lower()


def block_sizes(q: str, p: str) -> list[int]:
    """Sizes of the blocks of ``difflib.SequenceMatcher(None, q, p, autojunk=False)``, by substring search.

    The longest common run is the first in ``q`` among equals and then the first in ``p``; then both sides of it follow.
    """
    sizes, todo = [], [(0, len(q), 0, len(p))]
    while todo:
        i, q_end, p_start, p_end = todo.pop()
        q_start, at, size = i, i, 0
        while i + size < q_end:
            if p.find(q[i : i + size + 1], p_start, p_end) >= 0:
                at, size = i, size + 1
            else:
                i += 1
        if size:
            j = p.find(q[at : at + size], p_start, p_end)
            sizes.append(size)
            todo += [(q_start, at, p_start, j), (at + size, q_end, j + size, p_end)]
    return sizes


def measures(quote: str | None, passage: str | None, fold=fold_marks) -> tuple[float, int, int]:
    """share of the quote's characters in blocks that match the passage in order, the longest block, and the length of
    the folded quote."""
    q = fold(quote or "")
    if not q:
        return 0.0, 0, 0
    p = fold(passage or "")
    if q in p:  # the one block that the search would find
        return 1.0, len(q), len(q)
    sizes = block_sizes(q, p)
    return sum(sizes) / len(q), max(sizes, default=0), len(q)


def coverage(quote: str | None, passage: str | None, fold=fold_marks) -> tuple[float, int]:
    """F10 without the length."""
    return measures(quote, passage, fold)[:2]


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def run_hashes(s: str, width: int) -> np.ndarray:
    """A hash of each run of ``width`` characters, by doubling."""
    part = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(part) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, size, step = np.zeros(n, np.uint64), 0, 1
    while True:  # ``part`` has the hashes of runs of ``step`` characters
        if width & step:
            out = out * np.uint64(pow(_BASE, step, 1 << 64)) + part[size : size + n]
            size += step
        if 2 * step > width:
            return (out ^ (out >> np.uint64(31))) * _MIX
        part = part[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + part[step:]
        step *= 2


class Runs:
    """Which of some folded quotes share a run of ``block`` characters with a passage, or stand in it if they are shorter.

    Hashes only choose the places at which the characters themselves are looked up.
    """

    def __init__(self, quotes: list[str], block: int) -> None:
        self.block, self.at, self.short = block, {}, []
        for i, q in enumerate(quotes):
            if len(q) < block:
                self.short.append((i, q))
            for k in range(len(q) - block + 1):
                self.at.setdefault(q[k : k + block], set()).add(i)
        bits = max(12, len(self.at).bit_length() + 7)
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        for run in self.at:
            self.seen[run_hashes(run, block) >> self.shift] = True

    def shared(self, passage: str) -> set[int]:
        found = {i for i, q in self.short if q in passage}
        if self.at:
            for k in np.flatnonzero(self.seen[run_hashes(passage, self.block) >> self.shift]).tolist():
                found |= self.at.get(passage[k : k + self.block], set())
        return found


def paired(docs: DataFrame, quotes: DataFrame, folds: list[Callable[[str], str]], block: int = MIN_BLOCK) -> DataFrame:
    """``(doc_id, item_id, quote, text)`` of each row of ``docs(doc_id, text)`` and each of ``quotes(item_id, quote)`` that
    share a run of ``block`` characters (all of the quote, if it is shorter) after one of ``folds``.

    F11 asks for such a run, so with ``fold_marks`` no grounded pair is missing. The quotes are a query set of at most
    MOST_CHARS characters, which is collected; each task holds it against its own documents, and nothing is shuffled. A
    larger set is an error, to be asked in several goes. Nulls meet nothing.
    """
    size = quotes.agg(F.coalesce(F.sum(F.length("quote")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"the quotes have {size} characters, more than the {MOST_CHARS} that may be sent to every task")
    asked = [tuple(r) for r in quotes.where(F.col("quote").isNotNull()).select("item_id", "quote").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [(fold, Runs([fold(q) for _, q in asked], block)) for fold in folds]

        def made(batch: pa.RecordBatch, rows: list[int], at: list[int]) -> pa.RecordBatch:
            doc_id, text = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1))
            return pa.RecordBatch.from_arrays([doc_id, pa.array([asked[i][0] for i in at], pa.int64()), pa.array([asked[i][1] for i in at], pa.string()), text], ["doc_id", "item_id", "quote", "text"])

        for batch in batches:
            rows, at, size = [], [], 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                for i in sorted(set().union(*(index.shared(fold(text)) for fold, index in indexes))):
                    rows.append(row)
                    at.append(i)
                    size += len(text)
                    if size > 1 << 22:
                        yield made(batch, rows, at)
                        rows, at, size = [], [], 0
            if rows:
                yield made(batch, rows, at)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, quote string, text string")


# Whole texts go through these, so they are no Arrow functions: a task has a hundred rows at a time in Python instead of
# batches of 10 000 rows or 64 MB, each of them as Arrow buffers and as strings.


@F.udf(T.StringType(), useArrow=False)
def normalised(s: str | None) -> str | None:
    return None if s is None else fold_spaces(s)


@F.udf(T.StringType(), useArrow=False)
def normalised_marks(s: str | None) -> str | None:
    return None if s is None else fold_marks(s)


@F.udf(T.StructType().add("coverage", T.DoubleType()).add("longest", T.IntegerType()).add("length", T.IntegerType()), useArrow=False)
def quote_coverage(quote: str | None, passage: str | None) -> tuple[float, int, int]:
    """F10 with folded marks, and the length of the folded quote."""
    return measures(quote, passage)


@F.udf(T.StructType().add("coverage", T.DoubleType()).add("longest", T.IntegerType()), useArrow=False)
def plain_coverage(quote: str | None, passage: str | None) -> tuple[float, int]:
    """F10 with folded spaces only."""
    return coverage(quote, passage, fold_spaces)


def grounded(measured: Column, tau: float = TAU, min_block: int = MIN_BLOCK) -> Column:
    """F11 over what ``quote_coverage`` measured; with stored measures, gating anew is a filter."""
    return (measured["length"] > 0) & (measured["coverage"] >= tau) & (measured["longest"] >= F.least(F.lit(min_block), measured["length"]))


def gate_verdicts(df: DataFrame, verdict: str = "verdict", quote: str = "evidence_quote", passage: str = "passage") -> DataFrame:
    """a verdict of ``met`` whose quote is not grounded becomes ``unclear`` and is flagged. No other texts are sent to Python."""
    met = F.col(verdict) == "met"
    fails = met & ~grounded(F.col("__m"))
    out = df.withColumn("__m", quote_coverage(F.when(met, F.col(quote)), F.when(met, F.col(passage)))).withColumn("grounding_failed", F.coalesce(fails, F.lit(False)))
    return out.withColumn(verdict, F.when(F.col("grounding_failed"), F.lit("unclear")).otherwise(F.col(verdict))).drop("__m")


def gate_graded(df: DataFrame, agreement: str = "agreement", quote: str = "evidence_quote", passage: str = "passage") -> DataFrame:
    """a positive agreement whose quote is not grounded becomes 0; the value before, the coverage and a flag stay."""
    out = df.withColumn("__m", quote_coverage(F.col(quote), F.col(passage)))
    out = out.withColumn("raw_agreement", F.coalesce(F.col(agreement), F.lit(0.0))).withColumn("coverage", F.col("__m.coverage"))
    out = out.withColumn("grounding_failed", (F.col("raw_agreement") > 0) & ~grounded(F.col("__m")))
    return out.withColumn(agreement, F.when(F.col("grounding_failed"), F.lit(0.0)).otherwise(F.col(agreement))).drop("__m")


def classify_cells(df: DataFrame, quote: str = "evidence_quote", passage: str = "passage") -> DataFrame:
    """``strict`` (verbatim but for spaces), ``fuzzy`` (F11) and ``newly_passes`` for each pair."""
    q = normalised(F.col(quote))
    out = df.withColumn("__q", q).withColumn("__p", normalised(F.col(passage))).withColumn("__m", quote_coverage(F.col(quote), F.col(passage)))
    out = out.withColumn("strict", (F.col("__q") != "") & F.contains("__p", "__q")).withColumn("fuzzy", grounded(F.col("__m")))
    return out.withColumn("newly_passes", F.col("fuzzy") & ~F.col("strict")).drop("__q", "__p", "__m")


def gate_cost(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Tally of classified cells by judge and in all (a null judge); ``weight`` names a count of equal cells."""
    n = F.col(weight) if weight else F.lit(1).cast("long")
    tally = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    return df.rollup(*by).agg(
        tally(F.lit(True)).alias("cells"), tally(F.col("strict")).alias("strict"), tally(F.col("fuzzy")).alias("fuzzy"), tally(F.col("newly_passes")).alias("newly_passes"),
        tally(F.col("passage").isNull()).alias("missing"),
    )


def ground_items(df: DataFrame, quote: str = "quote", passage: str = "passage") -> DataFrame:
    """the items whose quote is grounded in their passage."""
    return df.withColumn("__m", quote_coverage(F.col(quote), F.col(passage))).where(grounded(F.col("__m"))).drop("__m")
