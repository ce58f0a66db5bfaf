"""Byte-level BPE by monoid tree reduction, and its decoding.

The encodings of byte strings form a monoid: ``join(encode(a), encode(b)) == encode(a + b)``. A string is encoded by
halves, recursively. Neighbours are joined by encoding a window around the seam again: at first the tokens on either
side, then more on each side that has not settled, twice as many each time. A side has settled when the window's outer token and the token
next to it outside stay two tokens if encoded together. An encoding in which each pair of neighbours stays two tokens
is the encoding, so once both sides have settled nothing outside the window can change. Texts are cut into the matches of
the pattern first, and those are encoded separately. Decoding concatenates bytes up the tree.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space between two characters that are not white space always begins a match of the pattern.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
CLOSE_SPACES = re.compile(r"\s\s")
#: Characters of a text that are cut into words together.
STRETCH = 1 << 20


def stretches(text: str) -> Iterator[str]:
    """Parts of about STRETCH characters, cut at spaces that begin a match, so that a long text is not split all at once."""
    at = 0
    while len(text) - at > STRETCH and (cut := SAFE_CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Units(dict):
    """Ids of words that follow a space, made when first asked for; two generations of bounded size."""

    def __init__(self, encoder: TreeEncoder, room: int) -> None:
        self.encoder, self.room, self.older = encoder, room, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encoder.encode_unit(" " + word)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class TreeEncoder:
    """Encoder of byte strings and texts. Caches are bounded: one that reaches ``room`` entries starts afresh.

    The cache of text units has two generations, so that units in use survive a fresh start. Texts are cut at spaces for
    it under the default pattern only, of which it is known that a match begins there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 200_000) -> None:
        import regex

        self.ranks, self.room = ranks, room
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.find, self.safe = regex.compile(pattern).findall, pattern == default_pattern()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.units = _Units(self, 2 * room)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The merges themselves, on the bytes of a window: the lowest rank first, the leftmost among equals."""
        found = self.windows.get(data)
        if found is None:
            if len(data) > 48:
                return self._merged_long(data)
            ranks = self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            around = [ranks.get(data[i : i + 2], 1 << 30) for i in range(len(data) - 1)]
            while around:
                best = min(around)
                if best == 1 << 30:
                    break
                at = around.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del around[at]
                if at:
                    around[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 30)
                if at < len(around):
                    around[at] = ranks.get(parts[at] + parts[at + 1], 1 << 30)
            if len(self.windows) >= self.room:
                self.windows.clear()
            found = self.windows[data] = tuple([ranks[p] for p in parts])
        return found

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same merges for long windows, from a heap of pairs over a linked list of parts."""
        ranks, n = self.ranks, len(data)
        ends = list(range(1, n + 1))  # the part that begins at i ends at ends[i]; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if before[i] >= 0 and (r := ranks.get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def stays(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.room:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == (a, b)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both strings together, from the encodings of each."""
        if not left or not right:
            return left or right
        if self.stays(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = self.merged(b"".join([self.tokens[t] for t in left[i:] + right[:j]]))
            settled_left = i == 0 or self.stays(left[i - 1], window[0])
            settled_right = j == len(right) or self.stays(window[-1], right[j])
            if settled_left and settled_right:
                return left[:i] + window + right[j:]
            if not settled_left:
                i = max(0, i - step)
            if not settled_right:
                j = min(len(right), j + step)
            step *= 2

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern, by halves."""
        if len(data) <= 1:
            return (self.ranks[data],) if data else ()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        found = self.halves.get(data)
        if found is None:
            middle = len(data) // 2
            found = self.join(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))
            if len(data) <= 16:
                if len(self.halves) >= self.room:
                    self.halves.clear()
                self.halves[data] = found
        return found

    def encode_unit(self, text: str) -> bytes:
        """Ids of a stretch of text that begins and ends with matches, as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for match in self.find(text):
            ids += self.encode_bytes(match.encode("utf-8", "surrogatepass"))
        return array("I", ids).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text or not self.safe:
            return self.encode_unit(text)
        out = []
        for part in stretches(text):
            words = SAFE_CUT.split(part) if CLOSE_SPACES.search(part) else part.split(" ")
            out.append(self.encode_unit(words[0]) if words[0] else b"")
            out += map(self.units.__getitem__, words[1:])
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist() if text else []

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined up the tree: each level concatenates runs of the one below."""
        level = list(map(self.tokens.__getitem__, ids))
        while len(level) > 4096:
            level = [b"".join(level[i : i + 4096]) for i in range(0, len(level), 4096)]
        return b"".join(level)


def encode_table(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs(doc_id, text)``.

    Rows are independent: no shuffle, one batch at a time. A null text counts as empty, which has no ids. Repeated
    rows are encoded alike; an empty table gives an empty result. ``path`` names the rank file on every machine.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(load_ranks(path), pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few rows at a time, since texts may be long
                batch = whole.slice(at, 256)
                held, counts, digests, decoded = [], [], [], []
                for text in batch.column(1):
                    packed = encoder.encode_packed(text.as_py() or "")
                    counts.append(len(packed) // 4)
                    digests.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(array("I", packed))).hexdigest())
                    if ids:
                        held.append(packed)
                if ids:
                    values = pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32))
                    column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)
                else:
                    column = pa.nulls(len(counts), pa.list_(pa.int32()))
                made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), column, *made], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_table(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``encoded(doc_id, ids)``; null ids give a null text."""
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(load_ranks(path), default_pattern())
        for batch in batches:
            texts = [None if (x := ids.as_py()) is None else encoder.decode(x).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Query op6."""
    return encode_table(docs.select("doc_id", "text"), ids=False).drop("ids")
