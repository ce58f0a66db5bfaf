"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made row by row. Equal fingerprints are one class from then on, so a group of copies is one row.
Classes meet in buckets that agree on some blocks of bits: with b blocks and radius r, two fingerprints within r
bits agree on at least b - r whole blocks, so one bucket for each choice of b - r blocks loses no link. Inside a
bucket 64 fingerprints form a block of vertical bit planes; one step of a carry-save counter adds one bit position
to 64 distances at once, and a block is left as soon as all its distances exceed the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hashable, partitions, staged

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows that are compared together in one bucket; larger buckets are dealt into parts that meet in pairs.
BUCKET = 16_384
#: Stands for a missing id, behind all others.
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text; A-Z in lower case, words as in the whole subpackage."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 for a text without words."""
    hashes = np.array(shingle_hashes(text), "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``fp``, the text's fingerprint as a signed long, for each row."""
    keys = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], [*keys, "fp"])

    return docs.select(*keys, F.col("text").cast("string")).mapInArrow(run, f"{kinds}, fp long")


def tables(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the bucket keys for ``n`` fingerprints: the number of blocks with the least work.

    More blocks make more, but finer, buckets; the choice changes with n and never loses a link.
    """

    def work(blocks: int) -> float:
        key_bits = 64 * (blocks - radius) / blocks
        return math.comb(blocks, radius) * (4 + math.ceil((1 + n / 2**key_bits) / 64))

    blocks = min(range(radius + 1, radius + 5), key=work)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64 lanes) of fingerprints to (blocks, 64 bit positions) of words with a bit for each lane."""
    out = np.empty(lanes.shape, np.uint64)
    for p in range(64):
        bits = ((lanes >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def lanes_within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each comparison of a query with a block: the indices of those with a lane within ``radius``, and its lanes.

    ``alive`` has the lanes that count. Ones, twos and fours are the digits of 64 counters at once; ``over`` notes
    what passed seven. After every eighth plane comparisons without a lane left are dropped.
    """
    if radius > 6:
        raise ValueError("three digits hold distances up to 7")
    index = np.arange(len(query))
    ones, twos, fours, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    for p in range(64):
        x = planes[block, p] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        carry = fours & x
        fours ^= x
        over |= carry
        if p % 8 == 7:
            beyond = over.copy()
            for value in range(radius + 1, 8):
                beyond |= (ones if value & 1 else ~ones) & (twos if value & 2 else ~twos) & (fours if value & 4 else ~fours)
            alive = alive & ~beyond
            left = alive != 0
            if left.sum() < 0.7 * len(left) or p == 63:
                index, block, query, alive, ones, twos, fours, over = (a[left] for a in (index, block, query, alive, ones, twos, fours, over))
    return index, alive


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


def compare(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each connected group inside each bucket; rows come bucket by bucket."""
    n = len(fp)
    change = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.array([], np.int64)
    sizes = np.diff(np.r_[change, n])
    keep = np.repeat(sizes > 1, sizes)
    row, sizes = np.flatnonzero(keep), sizes[sizes > 1]
    if not len(row):
        return row, row
    blocks = -(-sizes // 64)
    first_block, first_row = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    within = np.arange(len(row)) - np.repeat(first_row, sizes)
    own = np.repeat(first_block, sizes) + within // 64
    lane = within % 64
    lanes, valid, back = np.zeros((blocks.sum(), 64), np.uint64), np.zeros((blocks.sum(), 64), np.uint8), np.zeros((blocks.sum(), 64), np.int64)
    lanes[own, lane], valid[own, lane], back[own, lane] = fp[row], 1, row
    planes, valid = planes_of(lanes), np.packbits(valid, axis=1, bitorder="little").view(np.uint64)[:, 0]
    turns = np.repeat(first_block + blocks, sizes) - own  # a row meets its own block and the later ones
    ends = np.cumsum(turns)
    label = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending, at = 0, 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk)))
        t = turns[at:to]
        of = np.repeat(np.arange(at, to), t)
        block = np.repeat(own[at:to], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        later = ~((np.uint64(2) << lane[of].astype(np.uint64)) - np.uint64(1))  # lanes behind the row's own
        alive = np.where(block == own[of], valid[block] & later, valid[block])
        index, hits = lanes_within(planes, block, fp[row[of]], alive, radius)
        if len(index):
            pair, where = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found.append((row[of[index[pair]]], back[block[index[pair]], where]))
            pending += len(pair)
        if pending > 1 << 21:
            found = [_spanned(n, found, label)]
            pending = len(found[0][0])
        at = to
    return _spanned(n, found, label) if found else (row[:0], row[:0])


def _spanned(n: int, found: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = spanning(n, np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))
    moved = np.flatnonzero(root != label)
    return moved, root[moved]


def bucket_links(classes: DataFrame, masks: list[int], radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """``(u, v)``: links that span the groups of each bucket, from distinct ``classes(fp)``."""
    spark = classes.sparkSession
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(keys).alias("b")).select("fp", "b.t", "b.key")
    # large buckets are dealt into parts, and each pair of parts meets once
    large = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = staged(large.select("t", "key", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "buckets")
    rows = rows.withColumn("parts", F.lit(1)) if large.isEmpty() else rows.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", F.xxhash64("t", "key", F.least("p", "q"), F.greatest("p", "q")).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = compare(bucket, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

        held_b, held_f, n = [], [], 0
        for batch in batches:
            held_b.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_f.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n > 200_000:  # whole buckets only; the last one may go on
                bucket, fp = np.concatenate(held_b), np.concatenate(held_f)
                cut = int(np.searchsorted(bucket, bucket[-1]))
                if cut:
                    yield links(bucket[:cut], fp[:cut])
                held_b, held_f, n = [bucket[cut:]], [fp[cut:]], n - cut
        if n:
            yield links(np.concatenate(held_b), np.concatenate(held_f))

    count = partitions(spark)
    dealt = rows.select("bucket", "fp").repartition(count, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "u long, v long")


def components(prints: DataFrame, least: Column, radius: int = RADIUS) -> DataFrame:
    """``(fp, component_id)`` for each fingerprint of ``prints(fp, ...)``: the lowest ``least`` of its component."""
    classes = staged(prints.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    links = bucket_links(classes.select("fp"), tables(classes.count(), radius), radius)
    nodes = staged(connected_components(links), "components")
    labelled = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    labelled = staged(labelled, "labelled")
    least_of = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.select("fp", "component").join(least_of, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``.

    Documents without words have fingerprint 0 and link with each other and with fingerprints near 0. A null text
    has no words. Rows that share an id are rows of their own; a null id never becomes a component_id unless the
    component has none other. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs.select(F.col("doc_id").cast("long"), "text")), "fingerprints")
    return prints.join(components(prints, F.col("doc_id"), radius), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digest(docs: DataFrame) -> DataFrame:
    """Query op4."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest id, a null id last.

    Of rows that share this id the one with the lowest hash of its columns stays, and of rows that are equal in all
    columns one. Rows are met by id and hash, so a group of copies is never gathered; names of columns cannot clash.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(*hashable(docs)).alias("tie"), "text", F.struct("*").alias("row"))
    prints = staged(fingerprints(keyed.select("did", "tie", "text")), "fingerprints")
    chosen = components(prints, F.struct("did", "tie")).select("component_id.*").distinct()
    chosen = staged(prints.join(chosen, ["did", "tie"]).groupBy("did", "tie").agg(F.count(F.lit(1)).alias("n")), "chosen")
    rows, repeated = keyed.select("did", "tie", "row"), chosen.where("n > 1")
    out = rows.join(chosen.where("n = 1"), ["did", "tie"], "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, ["did", "tie"], "left_semi").dropDuplicates(["did", "tie"]))
    return out.select("row.*")
