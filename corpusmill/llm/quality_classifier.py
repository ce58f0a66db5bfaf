"""Compression classifier of quality: zstandard dictionaries of good and of bad text.

A text of one kind compresses better with a dictionary of its kind. A text is compressed in short blocks, so that what it
holds of itself does not drown what the dictionaries know, and in each block the difference of the two sizes over their
sum is the evidence. A logistic curve over the whole text's difference and the spread of its blocks' differences, fitted on
labelled texts that no dictionary has seen, makes a score from 0 to 1 of them; nothing but these differences enters it.
A short end is compressed with the block before it, so every byte counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows of either label, and characters of a row that may take part.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
DICTIONARY_BYTES, BLOCK, LEVEL = 262_144, 128, 6


@dataclass
class Model:
    """Two dictionaries and the weights of the calibration."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray


def blocks(data: bytes) -> list[bytes]:
    """All of the bytes in blocks; a last block of under a quarter is part of the one before it."""
    starts = range(0, max(1, len(data) - BLOCK // 4 + 1), BLOCK)
    return [data[at : at + BLOCK] if at != starts[-1] else data[at:] for at in starts]


class Scorer:
    """A model with its compressors, which cannot be sent between processes and are made where they work."""

    def __init__(self, model: Model) -> None:
        import zstandard

        self.model = model
        make = lambda data: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=LEVEL, write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(model.good), make(model.bad)

    def evidence(self, text: str | None) -> list[float]:
        """Normalised size differences: of the whole text, and of its blocks the greatest, the least, the mean of those for
        bad, the mean of the two greatest, and the deviation. Zeros for a blank text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data.strip():
            return [0.0] * 6
        parts = blocks(data)
        good = np.array([len(self.good.compress(x)) for x in parts], float)
        bad = np.array([len(self.bad.compress(x)) for x in parts], float)
        each = (good - bad) / (good + bad)
        return [(good.sum() - bad.sum()) / (good.sum() + bad.sum()), each.max(), each.min(), np.maximum(each, 0).mean(), np.sort(each)[-2:].mean(), each.std()]


def fit(good: list[str], bad: list[str], seed: int = 42) -> Model:
    """Dictionaries from the first half of either kind, calibration from the second half."""

    def dictionary(texts: list[str]) -> bytes:
        rng = np.random.default_rng(seed)
        share = max(200, 4 * DICTIONARY_BYTES // max(1, len(texts)) // 4)
        pieces = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            at = int(rng.integers(0, max(1, len(data) - share)))
            pieces.append(data[at : at + share])
        rng.shuffle(pieces)
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\n" * 8

    half_g, half_b = len(good) // 2, len(bad) // 2
    model = Model(dictionary(good[:half_g] or good), dictionary(bad[:half_b] or bad), np.zeros(0), np.zeros(0), np.ones(0))
    scorer = Scorer(model)
    rest = [(t, 1.0) for t in good[half_g:]] + [(t, 0.0) for t in bad[half_b:]]
    if not good or not bad:
        model.weights, model.means, model.scales = np.r_[4.0 if good else -4.0 if bad else 0.0, np.zeros(6)], np.zeros(6), np.ones(6)
        return model
    x, y = np.array([scorer.evidence(t) for t, _ in rest]), np.array([v for _, v in rest])
    model.means, model.scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - model.means) / model.scales])
    w = np.zeros(x.shape[1])
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(60):  # Newton's method; a small penalty keeps weights finite where the kinds separate
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (p - y)) + 0.1 * np.r_[0, w[1:]]
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def score(scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1; blank texts have score 0."""
    m = scorer.model
    x = (np.array([scorer.evidence(t) for t in texts]).reshape(-1, 6) - m.means) / m.scales
    out = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
    return np.where([not (t or "").encode("utf-8", "surrogatepass").strip() for t in texts], 0.0, out)


def fold(doc_id: str = "doc_id", of: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[int, list[str]]:
    """Texts by label, at most ``rows`` of either, those with the lowest hashes of their ids.

    The choice is made from ids and lengths; only chosen texts (at most 2 * rows * chars characters) leave the
    executors, met by a broadcast of at most 2 * rows ids. Of rows that share an id the least text counts, of labels that
    share one the greatest.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    fits = docs.where(usable & F.col("doc_id").isNotNull() & F.length("text").between(1, chars))
    both = fits.select("doc_id").distinct().join(marked, "doc_id").select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    chosen = [both.where(F.col("label") == value).orderBy("h", "doc_id").limit(rows) for value in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "label", "h").collect()
    if not ids:
        return {0: [], 1: []}
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in ids], "doc_id long, label int, h long"))
    texts = fits.join(few, "doc_id").groupBy("label", "h", "doc_id").agg(F.min("text").alias("text")).collect()
    texts = sorted((r["label"], r["h"], r["doc_id"], r["text"]) for r in texts)
    return {value: [t for v, _, _, t in texts if v == value] for value in (0, 1)}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels are learnt from rows outside the held-out fold only. A null or blank text has score 0. A null id is in
    no fold (held_out false). Without labels of one kind all scores lean to the other; an empty table gives an empty
    result. Rows are independent: no shuffle but for the sample, which is bounded by ``SAMPLE_ROWS``.
    """
    sample = labelled_sample(docs, labels, "quality", fold() != 0)
    model = fit(sample[1], sample[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score(scorer, pdf["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
