"""Toxicity by subword bags: vectors of character n-grams, averaged, under a linear softmax.

A word is the mean of the vectors of its n-grams (hashed, with marks at both ends), a window the mean of its words, and
a linear softmax on top says how toxic the window is; vectors and softmax are trained together by gradient descent in
numpy. A misspelling shares most n-grams with the word it spoils. Labels belong to documents, while only few of their
words are toxic: after a first pass over all windows, toxic documents are taught by their most toxic windows only, and a
document's evidence is its most toxic window. (That departs from one bag a document: the average over a long text drowns a
single word.) Scores of n-grams are the mean over several trainings, each on a part of the sample, and a logistic curve,
fitted on what each says of the part that it has not seen, turns the evidence into a score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import fold, labelled_sample

GRAMS, BITS, DIMENSIONS, WINDOW = (3, 4, 5, 6), 18, 16, 3
#: Bounds of the labelled sample: rows of either label, and characters of a row that may take part.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 12_000
#: Bytes of text that are scored together, and of a word; what is longer without white space counts as several words.
CHUNK, LONGEST = 1 << 20, 1 << 16
#: Parts of the sample that take turns in calibrating, and the weight of a toxic row in it.
PARTS, MISSED = 4, 2.0
BLANK = re.compile(r"[\x20\x09-\x0D]")


@dataclass
class Model:
    """The score of each n-gram (its vector times the softmax's difference of weights), the bias and the calibration."""

    gram_scores: np.ndarray
    bias: float
    calibration: np.ndarray


def _pieces(text: str | None) -> Iterator[tuple[bytes, int, int]]:
    """The words of a text in single spaces, in pieces of about CHUNK bytes: the bytes, how many words they are, and how
    many of these the piece before had too, so that every window of words lies in a piece."""
    text, at, carried = text or "", 0, []
    while at < len(text):
        cut = BLANK.search(text, at + CHUNK // 4) if len(text) - at > CHUNK // 4 else None
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().encode("utf-8", "surrogatepass").split()
        if end - at > LONGEST // 4:
            words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
        begin, words = len(carried), carried + words
        ends = np.cumsum([len(w) + 1 for w in words])
        while begin < len(words):
            to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK)))
            piece = words[max(0, begin - WINDOW + 1) : to]
            yield b" " + b" ".join(piece) + b" ", len(piece), len(piece) - (to - begin)
            begin = to
        at, carried = end, words[1 - WINDOW :]


def grams(data: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Words in the bytes, and for each size of n-gram the word and the hash of each n-gram.

    ``data`` has words in single spaces; an n-gram may begin or end on a space but not hold one inside.
    """
    space = data == 32
    starts = np.zeros(len(data), bool)
    starts[:-1] = space[:-1] & ~space[1:]
    word = np.cumsum(starts, dtype=np.int32) - 1
    wide = data.astype(np.uint32)
    inside = np.zeros(len(data), bool)
    value, out = wide.copy(), []
    for n in range(1, max(GRAMS)):
        if n >= len(data):
            break
        value[:-n] = value[:-n] * np.uint32(0x01000193) + wide[n:]
        if n + 1 in GRAMS:
            at = np.flatnonzero(~inside[:-n])
            mixed = (value[at] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            out.append((word[at], (mixed >> np.uint32(32 - BITS)).astype(np.int32)))
        inside[:-n] |= space[n:]  # position n is inside for longer n-grams
    return int(word[-1]) + 1 if len(data) else 0, out


def word_scores(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    n, parts = grams(data)
    total, count = np.zeros(n), np.zeros(n)
    for word, h in parts:
        total += np.bincount(word, weights=table[h], minlength=n)
        count += np.bincount(word, minlength=n)
    return total / np.maximum(count, 1)


def document_evidence(texts: list[str | None], model: Model) -> np.ndarray:
    """(most toxic window's logit, log of the words) for each text; the logit is NaN for a text without words."""
    best, many = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    held, sizes, which, total = [], [], [], 0

    def flush() -> None:
        if not held:
            return
        scores = word_scores(np.frombuffer(b"".join(held), np.uint8), model.gram_scores)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        sums = np.r_[0.0, np.cumsum(scores)]
        last = np.repeat(np.maximum(ends - WINDOW, begins), sizes)  # where the piece's last window begins
        at = np.minimum(np.arange(len(scores)), last)
        to = np.minimum(at + WINDOW, np.repeat(ends, sizes))
        logits = (sums[to] - sums[at]) / (to - at)
        np.maximum.at(best, which, np.maximum.reduceat(logits, begins) + model.bias)

    for i, text in enumerate(texts):
        for data, n, again in _pieces(text):
            held.append(data)
            sizes.append(n)
            which.append(i)
            many[i] += n - again
            total += len(data)
            if total > CHUNK:
                flush()
                held, sizes, which, total = [], [], [], 0
    flush()
    return np.column_stack([np.where(many > 0, best, np.nan), np.log(np.maximum(many, 1))])


class _Trainer:
    """Windows of the sample as rows of hashed n-grams, and gradient descent over them."""

    def __init__(self, texts: list[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        number: dict[bytes, int] = {}
        tokens, sizes = array("i"), []
        for text in texts:
            words = text.lower().encode("utf-8", "surrogatepass").split()
            tokens.extend([number.setdefault(w, len(number)) for w in words])
            sizes.append(len(words))
        self.tokens, sizes = np.frombuffer(tokens, np.int32), np.array(sizes)
        n, parts = grams(np.frombuffer(b" " + b" ".join(number) + b" ", np.uint8))
        word = np.concatenate([w for w, _ in parts])
        h = np.concatenate([x for _, x in parts])
        self.h = h[np.argsort(word, kind="stable")]
        self.per_word = np.bincount(word, minlength=n)
        self.first = np.r_[0, np.cumsum(self.per_word)]
        begins = np.cumsum(sizes) - sizes
        counts = -(-sizes // WINDOW)
        self.document = np.repeat(np.arange(len(texts)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begin = np.repeat(begins, counts) + inner * WINDOW
        self.end = np.minimum(self.begin + WINDOW, np.repeat(begins + sizes, counts))
        self.vectors = self.rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
        self.softmax = self.rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.grown_v, self.grown_s = np.full(1 << BITS, 1e-6, np.float32), np.full((2, DIMENSIONS), 1e-6, np.float32)

    def _rows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the n-grams of windows, their weights in the window's mean, and where windows begin."""
        words = self.end[windows] - self.begin[windows]
        word = self.tokens[np.repeat(self.begin[windows] - (np.cumsum(words) - words), words) + np.arange(words.sum())]
        many = self.per_word[word]
        at = np.repeat(self.first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        weight = np.repeat(1.0 / (np.maximum(many, 1) * np.repeat(words, words)), many).astype(np.float32)
        ends = np.r_[0, np.cumsum(many)][np.cumsum(words)]
        return self.h[at], weight, np.r_[0, ends[:-1]]

    def epoch(self, windows: np.ndarray, toxic: np.ndarray, rate: float, batch: int = 256) -> None:
        order = self.rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            h, weight, begins = self._rows(windows[chosen])
            mean = np.add.reduceat(self.vectors[h] * weight[:, None], begins, axis=0)
            logits = mean @ self.softmax.T + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p
            error[np.arange(len(chosen)), toxic[chosen].astype(int)] -= 1
            slope = error.T @ mean
            widths = np.diff(np.r_[begins, len(h)])
            pulls = np.bincount(h, weights=weight * np.repeat(error[:, 1], widths), minlength=1 << BITS)  # error[:, 0] is its negative
            touched = np.flatnonzero(pulls)
            pull, along = pulls[touched].astype(np.float32), self.softmax[1] - self.softmax[0]
            self.grown_v[touched] += pull**2 * float(along @ along) / DIMENSIONS
            self.vectors[touched] -= rate * (pull / np.sqrt(self.grown_v[touched]))[:, None] * along
            self.grown_s += slope**2
            self.softmax -= rate * slope / np.sqrt(self.grown_s)
            self.bias -= rate * 0.2 * error.mean(axis=0)

    def gram_scores(self) -> np.ndarray:
        return self.vectors @ (self.softmax[1] - self.softmax[0])

    def window_logits(self, windows: np.ndarray) -> np.ndarray:
        table, out = self.gram_scores(), []
        for i in range(0, len(windows), 1024):
            h, weight, begins = self._rows(windows[i : i + 1024])
            out.append(np.add.reduceat(table[h] * weight, begins))
        return np.concatenate(out) + self.bias[1] - self.bias[0] if out else np.zeros(0)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve; a toxic row counts MISSED times, since missing one costs more than flagging a clean one."""
    x, w, counts = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1), np.where(y > 0, MISSED, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (counts * (p - y)) + 0.05 * np.r_[0, w[1:]])
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _trained(toxic: list[str], clean: list[str], seed: int) -> Model:
    """A model without calibration."""
    trainer = _Trainer(toxic + clean, seed)
    is_toxic = trainer.document < len(toxic)
    pos, neg = np.flatnonzero(is_toxic), np.flatnonzero(~is_toxic)
    rng = trainer.rng
    few = lambda a, n: a if len(a) <= n else np.sort(rng.choice(a, n, replace=False))
    first = np.r_[few(pos, 30_000), few(neg, 30_000)]
    for _ in range(3 if len(first) > 20_000 else 8):
        trainer.epoch(first, is_toxic[first], 0.3)
    for _ in range(3):
        logits = trainer.window_logits(pos)
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, trainer.document[pos], logits)
        taught = few(pos[logits >= best[trainer.document[pos]] - 1.0], 15_000)
        against = trainer.window_logits(neg)
        hard = neg[np.argsort(-against, kind="stable")[: len(taught)]]
        chosen = np.r_[taught, few(neg, 2 * len(taught)), hard]
        for _ in range(3 if len(chosen) > 10_000 else 8):
            trainer.epoch(chosen, is_toxic[chosen], 0.3)
    return Model(trainer.gram_scores().astype(np.float32), float(trainer.bias[1] - trainer.bias[0]), np.zeros(3))


@dataclass
class Part:
    """What one training gives: its model, and its evidence of the rows that it has not seen, with their labels."""

    model: Model
    evidence: np.ndarray
    labels: np.ndarray


def _parts(toxic: list[str], clean: list[str]) -> int:
    return min(PARTS, len(toxic), len(clean))


def _part(toxic: list[str], clean: list[str], part: int, parts: int, seed: int) -> Part:
    split = lambda texts, inside: texts if parts == 1 else [t for i, t in enumerate(texts) if (i % parts == part) == inside]
    model = _trained(split(toxic, False), split(clean, False), seed + part)
    held_t, held_c = split(toxic, True), split(clean, True)
    return Part(model, document_evidence(held_t + held_c, model), np.r_[np.ones(len(held_t)), np.zeros(len(held_c))])


def _combined(parts: list[Part]) -> Model:
    mean = np.mean([p.model.gram_scores for p in parts], axis=0).astype(np.float32)
    calibration = _logistic(np.vstack([p.evidence for p in parts]), np.concatenate([p.labels for p in parts]))
    return Model(mean, float(np.mean([p.model.bias for p in parts])), calibration)


def _one_kind(toxic: list[str]) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 0.0, np.array([4.0 if toxic else -4.0, 0.0, 0.0]))


def fit(toxic: list[str], clean: list[str], seed: int = 42) -> Model:
    """The mean of PARTS models, each trained without a part of the sample; what they say of the parts that they have not
    seen calibrates it. With less than two rows of either kind one model is trained and calibrated on all."""
    toxic, clean = [t for t in toxic if t.split()], [t for t in clean if t.split()]
    n = _parts(toxic, clean)
    return _combined([_part(toxic, clean, i, n, seed) for i in range(n)]) if n else _one_kind(toxic)


def score(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of label 1; a text without words has score 0."""
    x = document_evidence(texts, model)
    w = model.calibration
    out = 1 / (1 + np.exp(-np.clip(w[0] + np.nan_to_num(x) @ w[1:], -30, 30)))
    return np.where(np.isnan(x[:, 0]), 0.0, out)


def train(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Model:
    """``fit`` on the labelled sample, with each training as a task; the sample, which is bounded, is broadcast to them and
    a megabyte of scores comes back from each."""
    sample = labelled_sample(docs, labels, "toxic", fold(of=4) != 2, SAMPLE_ROWS, SAMPLE_CHARS)
    toxic, clean = ([t for t in sample[label] if t.split()] for label in (1, 0))
    n = _parts(toxic, clean)
    if not n:
        return _one_kind(toxic)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((toxic, clean))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"].tolist():
                made = _part(*shared.value, i, n, seed)
                yield pd.DataFrame({"id": [i], "scores": [made.model.gram_scores.tobytes()], "bias": [made.model.bias], "evidence": [made.evidence.tobytes()], "labels": [made.labels.tobytes()]})

    rows = spark.range(0, n, 1, n).mapInPandas(run, "id long, scores binary, bias double, evidence binary, labels binary").collect()
    shared.unpersist()
    read = lambda data, kind: np.frombuffer(bytes(data), kind)
    return _combined([Part(Model(read(r["scores"], np.float32), r["bias"], np.zeros(3)), read(r["evidence"], float).reshape(-1, 2), read(r["labels"], float)) for r in sorted(rows)])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels are learnt from rows outside the held-out fold only. A null or blank text has score 0. A null id is in
    no fold (held_out false). Without labels of one kind all scores lean to the other; an empty table gives an empty
    result. Rows are independent: no shuffle but for the sample, which is bounded by ``SAMPLE_ROWS``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score(pdf["text"].tolist(), shared.value)})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(of=4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with the columns of ``docs``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(score(texts.tolist(), shared.value))

    return docs.where(toxicity(F.col("text").cast("string")) < threshold)
