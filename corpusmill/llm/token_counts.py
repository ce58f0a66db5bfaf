"""Token counts of a unigram tokenizer by dynamic programming over a trie.

A pre-token's best segmentation is found by a forward pass over its characters; pre-tokens that begin alike share that
pass. The distinct pre-tokens of a task's texts go into a trie, whose nodes carry the best score of the prefix they
spell and the number of pieces that reach it; a node is computed once, when the first pre-token passes it. The count at
the node where a pre-token ends is its number of tokens. A pre-token of more than LONG bytes makes the same pass without
the trie, and keeps scores as far back as the longest piece reaches.

The pieces are those of a public byte-level vocabulary. Unigram scores are not trained but follow from the ranks by
Zipf's rule: score = -ln(rank + 2.7), its usual offset. All single bytes are pieces, so every text can be segmented.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CLOSE_SPACES, SAFE_CUT, default_pattern, default_ranks, load_ranks, stretches

OFFSET = 2.7
#: Bytes of a pre-token that may enter the trie.
LONG = 1024


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    return {piece: -math.log(rank + OFFSET) for piece, rank in ranks.items()}


class CountingTrie:
    """A trie over byte strings. A node is a list: best score, pieces on the best path, children by byte.

    Of equally good paths the one with fewer pieces counts. The trie starts afresh once it has more than
    ``room`` nodes.
    """

    def __init__(self, scores: dict[bytes, float], room: int = 400_000) -> None:
        #: Every ending of a piece: its score, or minus infinity if it is no piece itself. A walk back from a character
        #: stops where no piece ends like that.
        self.endings: dict[bytes, float] = {}
        for piece in scores:
            for i in range(len(piece)):
                tail = piece[i:]
                if tail not in self.endings:
                    self.endings[tail] = scores.get(tail, -math.inf)
        self.longest = max(map(len, scores), default=1)
        self.room = room
        self.root: list = [0.0, 0, {}]
        self.nodes = 0
        self.terminal: dict[bytes, int] = {}

    def token(self, token: bytes) -> int:
        """Pieces of the best segmentation of ``token``, from its terminal count if it was met before."""
        if len(token) > LONG:
            return self.count_long(token)
        found = self.terminal.get(token)
        if found is None:
            if self.nodes > self.room:
                self.root, self.nodes, self.terminal = [0.0, 0, {}], 0, {}
            found = self.terminal[token] = self.count(token)
        return found

    def count(self, token: bytes) -> int:
        """The same from the trie; prefixes are computed where no other token has."""
        node, path, endings = self.root, [self.root], self.endings
        for end, byte in enumerate(token, 1):
            child = node[2].get(byte)
            if child is None:
                best, pieces, begin = -math.inf, 0, end - 1
                while begin >= 0:
                    score = endings.get(token[begin:end])
                    if score is None:
                        break
                    before = path[begin]
                    score += before[0]
                    if score > best or (score == best and before[1] + 1 < pieces):
                        best, pieces = score, before[1] + 1
                    begin -= 1
                child = node[2][byte] = [best, pieces, {}]
                self.nodes += 1
            node = child
            path.append(node)
        return node[1]


    def count_long(self, token: bytes) -> int:
        """The same in bounded memory."""
        endings, longest = self.endings, self.longest
        path, cut = [(0.0, 0)], 0  # the scores of prefixes of ``cut`` bytes and more
        for end in range(1, len(token) + 1):
            best, pieces, begin = -math.inf, 0, end - 1
            while begin >= 0:
                score = endings.get(token[begin:end])
                if score is None:
                    break
                before = path[begin - cut]
                score += before[0]
                if score > best or (score == best and before[1] + 1 < pieces):
                    best, pieces = score, before[1] + 1
                begin -= 1
            path.append((best, pieces))
            if len(path) > 16 * longest:
                cut += len(path) - longest
                del path[:-longest]
        return path[-1][1]


class _Units(dict):
    """Counts of words that follow a space, made when first asked for; two generations of bounded size."""

    def __init__(self, counter: TokenCounter, room: int) -> None:
        self.counter, self.room, self.older = counter, room, {}

    def __missing__(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = self.counter.unit(" " + word)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class TokenCounter:
    """Counts for texts: tokens, plus pre-tokens in the bits from ``SHIFT`` on."""

    SHIFT = 40

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 400_000) -> None:
        import regex

        self.trie = CountingTrie(piece_scores(ranks))
        self.find, self.safe = regex.compile(pattern).findall, pattern == default_pattern()
        self.units = _Units(self, room)

    def unit(self, text: str) -> int:
        """Both counts of a stretch of text that begins and ends with pre-tokens."""
        matches = self.find(text)
        return (len(matches) << self.SHIFT) + sum([self.trie.token(m.encode("utf-8", "surrogatepass")) for m in matches])

    def text(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        total = 0
        for part in stretches(text) if self.safe else [text]:
            words = [part] if not self.safe else SAFE_CUT.split(part) if CLOSE_SPACES.search(part) else part.split(" ")
            total += (self.unit(words[0]) if words[0] else 0) + sum(map(self.units.__getitem__, words[1:]))
        return total >> self.SHIFT, total & ((1 << self.SHIFT) - 1)


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` for each row of ``docs(doc_id, text)``.

    Rows are independent and nothing is shuffled; what a task keeps is bounded. A null or empty text has no tokens;
    repeated rows count alike; an empty table gives an empty result.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(load_ranks(path), pattern)
        for batch in batches:
            made = [counter.text(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def digest(docs: DataFrame) -> DataFrame:
    """Query op7."""
    return count_tokens(docs.select("doc_id", "text"))
