"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage counts as repeated from 20 words on. Of the suffixes of all texts only those are kept that can matter:
every window of 20 words has one anchor, the lowest hashed run of 6 words in it (the leftmost among equals), and equal
windows have equal anchors at equal places. Suffixes at anchors that occur once in the corpus are dropped. The others
are split by their prefix into groups that fit into memory. The prefix is the anchor's 6 words; where more than GROUP
suffixes share it, each window gives a suffix of its own, which begins where the window does and has all its 20 words
as its prefix. Suffixes that agree in so long a prefix are one node, so a task ships the first one only and marks its
others at once: however often a passage occurs, its group has at most one suffix a task.

In a group the suffixes are sorted, and the common prefixes of neighbours give the suffix tree: its nodes at depth d are
the runs of neighbours that share d words. A window that begins o words before the anchor is repeated where suffixes meet
in a node of depth 20 - o and their texts before the anchor meet in a node of depth o of the tree over the reversed left
contexts; nodes that deep are the maximal repeats' beginnings, and all their occurrences but the first are marked. Words
are compared themselves; hashes choose anchors, partitions and, by SHA-256, documents that are equal as a whole: of those
one goes through the trees, and the others are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

WINDOW, ANCHOR = 20, 6
#: Places in a window at which its anchor can begin.
PLACES = WINDOW - ANCHOR + 1
#: Suffixes that may share a prefix of an anchor's words before it is lengthened to the whole window.
GROUP = 20_000
#: Parts of a group of copies.
SALTS = 8
#: Lengthened suffixes that a task holds to combine equal ones before they are shipped.
HELD = 50_000
#: Suffixes that a task has in memory at once (whole groups, so up to GROUP times a document's repeats more).
CHUNK = 25_000
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, ANCHOR, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes; equal words have equal hashes."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.r_[starts, len(data)])
    longest = int(lengths.max())
    powers = np.cumprod(np.r_[np.uint64(1), np.full(longest, _BASE)], dtype=np.uint64)
    body = slice(int(starts[0]), len(data))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    terms = _BYTE[data[body]] * powers[place]
    terms[blank[body]] = 0
    return np.add.reduceat(terms, starts - starts[0])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, place, hash, lo, hi)`` of each anchor: which text, the word it begins at, and the range of the
    number of words by which the windows that have it as their anchor begin before it."""
    hashes = [word_hashes(np.frombuffer(t, np.uint8)) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    begins = np.cumsum(sizes) - sizes
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none, none
    n = len(words) - ANCHOR + 1
    runs = np.zeros(n, np.uint64)
    for i in range(ANCHOR):
        runs += words[i : i + n] * _PLACE[i]
    runs = (runs ^ (runs >> np.uint64(31))) * _MIX
    runs ^= runs >> np.uint64(29)
    text = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(text[: len(words) - WINDOW + 1] == text[WINDOW - 1 :])
    if not len(starts):
        return none, none, none, none, none
    # leftmost minimum over PLACES neighbours, by doubling: least value and its place over 2, 4, 8 .. neighbours
    value, at, width = runs, np.arange(n), 1
    while 2 * width <= PLACES:
        right = value[width:] < value[:-width]
        value, at = np.where(right, value[width:], value[:-width]), np.where(right, at[width:], at[:-width])
        width *= 2
    shift = PLACES - width
    if shift:
        right = value[shift:] < value[: len(value) - shift]
        at = np.where(right, at[shift:], at[: len(at) - shift])
    place = at[starts]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[starts[1:]] != text[starts[:-1]])])
    last = np.r_[first[1:], len(place)] - 1
    of = text[starts[first]]
    spot = place[first]
    return of, spot - begins[of], runs[spot].view(np.int64), spot - starts[last], spot - starts[first]


def _batches(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the index of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(data)
        size += len(data)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def anchor_table(docs: DataFrame) -> DataFrame:
    """``(did, tie, anchors)`` for each row of ``docs(did, tie, text)`` with a window: hashes of its anchors and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _batches(batch.column(2)):
                of, _, h, _, _ = anchors(texts)
                if not len(of):
                    continue
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
                count = np.diff(np.r_[new, len(of)]).astype(np.int32)
                docs_at = np.flatnonzero(np.r_[True, of[new][1:] != of[new][:-1]])
                pairs = pa.StructArray.from_arrays([pa.array(h[new]), pa.array(count)], ["h", "c"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[docs_at, len(new)].astype(np.int32)), pairs)
                rows = pa.array(first + of[new][docs_at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], ["did", "tie", "anchors"])

    return docs.mapInArrow(run, "did long, tie long, anchors array<struct<h:long,c:int>>")


SUFFIX = "h long, did long, tie long, place int, lo int, hi int, mask int, before binary, after binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
_NAMES = [c.split()[0] for c in SUFFIX.split(", ")]


def suffixes(marked: DataFrame) -> DataFrame:
    """Suffixes that may repeat, from ``marked(did, tie, text, shared, hot, ...)``: the document's repeated anchors by the
    length that their prefix has. A row with a mask is no suffix but a mark: its window has been met in this task before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        #: The least (did, tie, start) met of each lengthened prefix.
        held: dict[bytes, tuple[int, int, int]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
                rows.clear()

        def release() -> None:
            for window, (did, tie, start) in held.items():
                rows.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), did, tie, start, 0, 0, 0, b"", window))
            held.clear()

        def lengthened(did: int, tie: int, start: int, window: bytes) -> None:
            at, before = (did, tie, start), held.get(window)
            if before is None:
                held[window] = at
                return
            if at[:2] == before[:2] and start == before[2]:
                return
            held[window], again = (before, at) if before < at else (at, before)
            rows.append(((again[0] ^ again[2]) * 0x9E3779B97F4A7C15 % (1 << 63), *again, 0, 0, 1, None, None))

        for batch in batches:
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, texts in _batches(batch.column(2)):
                of, place, h, lo, hi = anchors(texts)
                edges = np.searchsorted(of, np.arange(len(texts) + 1))
                for i, data in enumerate(texts):
                    a, b = edges[i], edges[i + 1]
                    if a == b:
                        continue
                    did, tie = int(ids[first + i]), int(ties[first + i])
                    shared, hot = (batch.column(c)[first + i].values for c in (3, 4))
                    words = data.split()
                    if shared is not None and len(shared):
                        for k in (a + np.flatnonzero(np.isin(h[a:b], shared.to_numpy(zero_copy_only=False)))).tolist():
                            p = int(place[k])
                            rows.append((int(h[k]), did, tie, p, int(lo[k]), int(hi[k]), 0, b" ".join(words[max(0, p - PLACES + 1) : p]), b" ".join(words[p : p + WINDOW])))
                    if hot is not None and len(hot):
                        for k in (a + np.flatnonzero(np.isin(h[a:b], hot.to_numpy(zero_copy_only=False)))).tolist():
                            for start in range(int(place[k] - hi[k]), int(place[k] - lo[k]) + 1):
                                lengthened(did, tie, start, b" ".join(words[start : start + WINDOW]))
                            if len(held) >= HELD:
                                release()
                    if len(rows) >= 4096:
                        yield from flushed()
        release()
        yield from flushed()

    return marked.mapInArrow(run, SUFFIX)


def shared_prefixes(keys: np.ndarray, paths: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the paths by key and words, and the words that each has in common with the one before it."""
    key = keys.tolist()
    order = sorted(range(len(key)), key=lambda i: (key[i], paths[i]))
    common = np.zeros(len(order), np.int32)
    for j in range(1, len(order)):
        a, b = paths[order[j - 1]], paths[order[j]]
        if key[order[j - 1]] != key[order[j]]:
            common[j] = -1
        elif a is b or a == b:
            common[j] = len(a)
        else:
            n = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                n += 1
            common[j] = n
    return np.array(order, np.int64), common


def repeats(h: np.ndarray, did: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each suffix a bit for each o: the window that begins o words before the anchor also begins earlier."""
    n = len(h)
    right, right_common = shared_prefixes(h, [a.split() for a in after])
    left, left_common = shared_prefixes(h, [b.split()[::-1] for b in before])
    mask = np.zeros(n, np.int32)
    node_r, node_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(PLACES):
        valid = np.flatnonzero((lo <= o) & (o <= hi))
        if len(valid) < 2:
            continue
        node_r[right] = np.cumsum(right_common < WINDOW - o)
        node_l[left] = np.cumsum(left_common < o)
        node = node_r[valid] * (n + 1) + node_l[valid]
        order = np.lexsort((place[valid], did[valid], node))
        again = np.r_[False, node[order][1:] == node[order][:-1]]
        # occurrences at the same id and place (rows that share an id) are one occurrence
        same = np.r_[False, (did[valid][order][1:] == did[valid][order][:-1]) & (place[valid][order][1:] == place[valid][order][:-1])] & again
        first = np.maximum.accumulate(np.where(~again, np.arange(len(order)), 0))
        again &= ~(same & (place[valid][order] == place[valid][order][first]) & (did[valid][order] == did[valid][order][first]))
        mask[valid[order[again]]] |= 1 << o
    return mask


def tree_marks(rows: DataFrame) -> DataFrame:
    """``(did, tie, place, mask)`` of the repeats in each group of suffixes, and the marks that are among ``rows``.

    Groups are read one after another; a task holds CHUNK suffixes and the rest of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "tie", "place", "mask"]

        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            h = t.column("h").to_numpy()
            grouped = np.flatnonzero(np.r_[h[1:] == h[:-1], False] | np.r_[False, h[1:] == h[:-1]])
            if not len(grouped):
                return
            t = t.take(pa.array(grouped))
            h, did, tie, place, lo, hi = (t.column(c).to_numpy() for c in ("h", "did", "tie", "place", "lo", "hi"))
            order = np.lexsort((tie, did))
            document = np.zeros(len(did), np.int64)
            document[order] = np.cumsum(np.r_[False, (did[order][1:] != did[order][:-1]) | (tie[order][1:] != tie[order][:-1])])
            mask = repeats(h, document, place, lo, hi, t.column("before").to_pylist(), t.column("after").to_pylist())
            hit = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(did[hit]), pa.array(tie[hit]), pa.array(place[hit].astype(np.int32)), pa.array(mask[hit])], names)

        held, n = [], 0
        for batch in batches:
            masks = batch.column(6).to_numpy()
            if masks.any():
                at = pa.array(np.flatnonzero(masks))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (1, 2, 3, 6)], names)
                batch = batch.take(pa.array(np.flatnonzero(masks == 0)))
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield from solved(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if n:
            yield from solved(pa.Table.from_batches(held))

    dealt = rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "did long, tie long, place int, mask int")


def whole_copies(docs: DataFrame) -> DataFrame:
    """``(did, tie)`` of the documents whose text is that of an earlier one, from ``docs(did, tie, text)``.

    A text's copies meet its first document in SALTS parts, so that no task has them all.
    """
    hashed = staged(docs.select("did", "tie", F.sha2("text", 256).alias("m"), F.pmod(F.xxhash64("did"), F.lit(SALTS)).cast("int").alias("salt")), "texts")
    first = hashed.groupBy("m").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    first = first.select("m", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return staged(hashed.join(first, ["m", "salt"]).where(F.col("did") > F.col("first")).select("did", "tie").distinct(), "copies")


def repeated_anchors(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``(did, tie, shared, hot)``: anchors of each document that occur again, and those of them whose prefix is lengthened."""
    found = staged(anchor_table(docs), "anchors")
    each = found.join(copies, ["did", "tie"], "left_anti").select("did", "tie", F.explode("anchors").alias("x")).select("did", "tie", "x.h", "x.c")
    # rows that share an id and a text count twice here, which costs work and changes nothing
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).where("n > 1 or c > 1")
    counts = staged(counts.select("h", (F.col("c") > GROUP).alias("hot")), "shared")
    own = lambda hot: F.collect_set(F.when(F.col("hot") == hot, F.col("h")))
    return staged(each.join(counts, "h").groupBy("did", "tie").agg(own(False).alias("shared"), own(True).alias("hot")), "by-document")


def kept_words(text: str | None, copy: bool, places: np.ndarray, masks: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those that no repeated window covers."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if copy and n >= WINDOW:
        return n, []
    if not len(places) or n < WINDOW:
        return n, words
    edge = np.zeros(n + 1, np.int64)
    for o in range(PLACES):
        starts = places[(masks >> o) & 1 == 1] - o
        starts = starts[(starts >= 0) & (starts <= n - WINDOW)]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
    keep = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    return n, [words[i] for i in keep.tolist()]


def deduplicate(docs: DataFrame, rest: Column | None = None) -> DataFrame:
    """``(did, text, n_words, n_removed, kept_sha256[, rest, kept_text])`` for each row of ``docs(doc_id, text, ...)``.

    A text that equals an earlier document's whole text is removed whole if it has a window at all. A null text has
    no words. Rows that share an id and a text are one document: windows at the same place are one occurrence, and such
    rows stay together, without an id too. Different texts of one id are documents of their own, in the order of a hash
    of the text; rows without an id come after all others. Texts shorter than a window stay. An empty table gives an empty result.
    ``rest`` is a struct to carry along; the kept text then comes with it (null where nothing was removed).

    Texts are shuffled once, by document; both joins, with the anchors and with the marks, read that exchange.
    """
    more = [] if rest is None else ["rest"]
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([] if rest is None else [rest.alias("rest")]))
    source = source.select("did", F.xxhash64("text").alias("tie"), "text", *more)
    texts = source.select("did", "tie", "text")
    copies = whole_copies(texts)
    marked = source.join(repeated_anchors(texts, copies), ["did", "tie"]).select("did", "tie", "text", "shared", "hot", *more)
    marks = tree_marks(suffixes(marked)).groupBy("did", "tie").agg(F.collect_list("place").alias("places"), F.collect_list("mask").alias("masks"))
    known = marks.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    full = source.join(known, ["did", "tie"], "left")
    full = full.select("did", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "places", "masks", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, copy, places, masks in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                pair = [none, none] if places.values is None else [c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (places, masks)]
                n, kept = kept_words(text.as_py(), copy.as_py(), *pair)
                joined = b" ".join(kept)
                out[0].append(n)
                out[1].append(n - len(kept))
                out[2].append(hashlib.sha256(joined).hexdigest())
                out[3].append(joined.decode("utf-8", "surrogatepass") if more and n > len(kept) else None)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            made = [batch.column(0), *made, *([batch.column(1), batch.column(5)] if more else [])]
            yield pa.RecordBatch.from_arrays(made, ["did", "n_words", "n_removed", "kept_sha256", "kept_text", *(["text", "rest"] if more else [])])

    kind = f", text string, rest {full.schema['rest'].dataType.simpleString()}" if more else ""
    return full.mapInArrow(run, "did long, n_words long, n_removed long, kept_sha256 string, kept_text string" + kind)


def digest(docs: DataFrame) -> DataFrame:
    """Query op8."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select(F.when(F.col("did") < NO_ID, F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated words, with its columns; texts without repeats stay as they are, ``n_chars`` follows.

    A null text stays null. Other columns are carried along inside a struct, so no name can clash.
    """
    # the field called text says whether there is one
    rest = F.struct(*[F.col("text").isNotNull().alias(n) if n == "text" else F.col(n) for n in docs.columns])
    out, changed = deduplicate(docs, rest), F.col("kept_text").isNotNull()
    columns = {n: F.col("rest").getField(n) for n in docs.columns}
    columns["text"] = F.when(changed, F.col("kept_text")).when(F.col("rest.text"), F.col("text")).cast(docs.schema["text"].dataType)
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[n].alias(n) for n in docs.columns])
