"""Near-duplicate embeddings over an inverted multi-index.

Unit vectors are cut into halves, and each half has its own codebook; a pair of codewords is a cell of a product grid,
which indexes every vector. A vector visits cells in the order of a lower bound on the distance to anything in them:
what lies in a cell is nearer to the cell's codewords than to any other, so it lies beyond the bisecting planes, and the
distances to the planes of both halves add up. The traversal walks both sorted sequences of half bounds at once and
ends where the bound passes what the target recall asks for; at recall 1 that is the radius itself, and no link can be
missed, whatever the codebooks are. Visited pairs are verified in double precision.

Equal vectors are one class from the start. A block of cells with many members is dealt into parts that are searched
apart, and a task gives out sums of links and the links that span its groups, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, partitions, staged
from .simhash import spanning

THRESHOLD = 0.95
#: Bounds of the sample that the codebooks are fitted on: vectors and bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 24
#: Share of the links at the threshold itself that the traversal has to find; nearer ones are found more surely.
RECALL = 0.999
#: Members of a block that are aimed at and the most that are searched together, and queries that meet them at once.
BLOCK, PART, QUERIES = 1024, 4096, 2048


def vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, digest, dim, vec)``: components as bytes, and a 128-bit digest of them.

    Digest and bytes are null for vectors that are null, zero, or hold null or non-finite components, and in rows
    without an id.
    """
    wide = table.schema["embedding"].dataType.elementType.simpleString() == "double"
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], []]
            for vec_id, row in zip(batch.column(0), batch.column(1), strict=True):
                values = row.values
                x = None if values is None or not len(values) or values.null_count or not vec_id.is_valid else values.to_numpy(zero_copy_only=False).astype(kind)
                with np.errstate(over="ignore"):
                    good = x is not None and np.isfinite(x).all() and 0 < np.linalg.norm(x.astype(np.float64)) < np.inf
                data = (x + 0).tobytes() if good else None  # + 0: one zero only
                made[0].append(hashlib.blake2b(data, digest_size=16).digest() if good else None)
                made[1].append(len(x) if good else None)
                made[2].append(data)
            kinds = (pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m, k) for m, k in zip(made, kinds, strict=True)]], ["vec_id", "digest", "dim", "vec"])

    element = "double" if wide else "float"
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>")).mapInArrow(run, "vec_id long, digest binary, dim int, vec binary")


def unit(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    kind = "<f8" if data and len(data[0]) == 8 * dim else "<f4"
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means; codewords that lose all their rows stay where they are."""
    if x.shape[1] == 0:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T, 0)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and for each codeword a lower bound on the squared distance from the row to
    anything whose nearest codeword it is: the farthest of the bisecting planes that such a point lies beyond."""
    d = squared(x, centres)
    apart = np.sqrt(squared(centres, centres))
    out = np.zeros_like(d)
    for i in range(len(centres)):
        with np.errstate(divide="ignore", invalid="ignore"):
            planes = (d[:, i : i + 1] - d) / (2 * apart[i])
        planes[:, apart[i] < 1e-12] = 0
        out[:, i] = np.maximum(planes.max(axis=1), 0) ** 2
    return d.argmin(axis=1), out


def traverse(first: np.ndarray, second: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal for many rows: ``(row, i, j)`` of the cells whose bounds add up to ``radius2`` at most.

    Both sequences are sorted; for each step along the first the reachable steps of the second are a beginning of it,
    which never grows from one step to the next.
    """
    rows, steps, cells_i, cells_j = np.arange(len(first)), [], [], []
    order_i, order_j = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    sorted_i, sorted_j = np.take_along_axis(first, order_i, 1), np.take_along_axis(second, order_j, 1)
    for step in range(first.shape[1]):
        rows = rows[sorted_i[rows, step] + sorted_j[rows, 0] <= radius2]
        if not len(rows):
            break
        reach = (sorted_i[rows, step][:, None] + sorted_j[rows] <= radius2).sum(axis=1)
        row = np.repeat(rows, reach)
        at = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
        steps.append(row)
        cells_i.append(order_i[row, step])
        cells_j.append(order_j[row, at])
    none = np.zeros(0, np.int64)
    return (np.concatenate(steps), np.concatenate(cells_i), np.concatenate(cells_j)) if steps else (none, none, none)


def codewords_for(n: int) -> int:
    """Codewords of either book: about eight classes a cell, within 4 to 256."""
    return int(min(256, max(4, 2 ** round(math.log2(max(1.0, math.sqrt(n / 8)))))))


def radius2_for(threshold: float, recall: float, dim: int, k: int) -> float:
    """Squared bound at which the traversal may end.

    Unit vectors with cosine ``threshold`` are delta^2 = 2 - 2 * threshold apart, and at recall 1 that is the bound.
    A displacement in no special direction of a half has a share of more than t of its square in one direction with odds
    of (1 - t)^((h - 2) / 2), where h are the dimensions of the half; below 1 the bound is where those odds, once for each
    codeword near by (at most 16 are counted), come to 1 - recall. That holds for displacements inside one half, and
    leaves a margin for those that both halves share.
    """
    delta2, half = 2 - 2 * threshold, dim // 2
    if recall >= 1 or half <= 4:
        return delta2 + 1e-9
    odds = (1 - recall) / min(k, 16)
    return delta2 * (1 - odds ** (2 / (half - 2))) + 1e-9


def links(classes: DataFrame, dim: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(u, v, links)`` for classes of one dimension, ``classes(rep, n, vec)``.

    Rows with v have a link that spans a group; rows without say that u has ``links`` more vectors linked to it.
    Cells that share the first codeword are shipped to by the block, so a vector travels once a block and not once a
    cell; a bit for each cell of the block says which it visits, and it meets their members.
    """
    spark = classes.sparkSession
    # a share of the hashes, so that each task sends its few vectors and nothing is sorted; the limit hardly ever acts
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    share = F.lit(True) if n <= most else F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 32)) < int(0.9 * most / n * (1 << 32))
    sample = sorted(bytes(r["vec"]) for r in classes.where(share).select("vec").limit(most).collect())
    x, half = unit(sample, dim), dim // 2
    rng = np.random.default_rng(3)
    k = codewords_for(n)
    books = (codebook(x[:, :half], k, rng), codebook(x[:, half:], k, rng))
    radius2 = radius2_for(threshold, recall, dim, k)
    columns = len(books[1])
    wide = int(min(columns, max(1, BLOCK * len(books[0]) * columns // max(1, n))))  # second codewords of a block
    across = -(-columns // wide)

    def own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(batch.column(2).to_pylist(), dim) if batch.num_rows else np.zeros((0, dim))
            cell = squared(u[:, :half], books[0]).argmin(axis=1) * columns + squared(u[:, half:], books[1]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["rep", "n", "vec", "cell"])

    members = staged(classes.select("rep", "n", "vec").mapInArrow(own_cells, "rep long, n long, vec binary, cell int"), "cells")
    filled = np.zeros(len(books[0]) * columns, bool)
    sizes = np.zeros(len(books[0]) * across, np.int64)
    for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect():  # at most 65 536 rows
        filled[r["cell"]] = True
        sizes[r["cell"] // columns * across + r["cell"] % columns // wide] += r["m"]
    parts = np.maximum(1, -(-sizes // PART)).astype(np.int64)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "part", "own", "cell", "rep", "n", "vec", "visits"]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rep, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                block = cell // columns * across + cell % columns // wide
                u = unit(batch.column(2).to_pylist(), dim)
                part = np.array([hash_part(r, p) for r, p in zip(rep.tolist(), parts[block].tolist(), strict=True)], np.int64)
                row, i, j = traverse(bounds(u[:, :half], books[0])[1], bounds(u[:, half:], books[1])[1], radius2)
                later = (i * columns + j > cell[row]) & filled[i * columns + j]  # two cells meet in the later one
                pairs, at = np.unique(row[later] * len(sizes) + i[later] * across + j[later] // wide, return_inverse=True)
                own_too = np.setdiff1d(np.arange(len(rep)) * len(sizes) + block, pairs)  # for the earlier parts of its own cell
                visited = np.zeros((len(pairs) + len(own_too), wide), bool)  # the cells of the block
                visited[at, j[later] % wide] = True
                keys = np.r_[pairs, own_too]
                row, to = keys // len(sizes), keys % len(sizes)
                order = np.argsort(keys)
                home = order[np.searchsorted(keys[order], np.arange(len(rep)) * len(sizes) + block)]
                copies = np.where(np.arange(len(row)) < len(pairs), parts[to], part[row])
                at_part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                which = np.repeat(np.arange(len(row)), copies)
                which, at_part = (x[(to[which] != block[row[which]]) | (at_part != part[row[which]])] for x in (which, at_part))
                take = np.r_[np.arange(len(rep)), row[which]]
                made = [np.r_[block, to[which]].astype(np.int32), np.r_[part, at_part].astype(np.int32), np.arange(len(take)) < len(rep)]
                bits = np.packbits(visited[np.r_[home, which]], axis=1)
                picked = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*[pa.array(m) for m in made], picked.column(3), picked.column(0), picked.column(1), picked.column(2), pa.array(list(map(bytes, bits)), pa.binary())], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of row numbers that link, a cell of the block after the other."""
            own, cell, part, rep = (t.column(c).to_numpy() for c in ("own", "cell", "part", "rep"))
            first = int(t.column("block")[0].as_py())
            u = unit(t.column("vec").to_pylist(), dim)
            visited = np.unpackbits(np.frombuffer(b"".join(t.column("visits").to_pylist()), np.uint8).reshape(len(u), -1), axis=1).astype(bool)
            for c in np.unique(cell[own]).tolist():
                mine = np.flatnonzero(own & (cell == c))
                p, q = np.nonzero(np.triu(u[mine] @ u[mine].T >= threshold, 1))
                yield mine[p], mine[q]
                earlier = visited[:, c % columns % wide]
                others = np.flatnonzero(earlier | ((cell == c) & ~own & (later_part(rep, part, int(parts[first])))))
                for at in range(0, len(others), QUERIES):
                    few = others[at : at + QUERIES]
                    p, q = np.nonzero(u[mine] @ u[few].T >= threshold)
                    yield mine[p], few[q]

        def answer(table: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            us, vs, adds = [], [], []
            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                t = table.slice(a, b - a)
                rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy().astype(np.float64)
                more, label = np.zeros(b - a), np.arange(b - a)
                for p, q in group(t) if b - a > 1 and t.column("own").to_numpy().any() else ():
                    if len(p):
                        more += np.bincount(p, weights=n[q], minlength=b - a) + np.bincount(q, weights=n[p], minlength=b - a)
                        moved = np.flatnonzero(label != np.arange(b - a))
                        label = spanning(b - a, np.r_[p, moved], np.r_[q, label[moved]])
                moved, linked = np.flatnonzero(label != np.arange(b - a)), np.flatnonzero(more)
                us += [rep[moved], rep[linked]]
                vs += [rep[label[moved]], np.full(len(linked), -1)]
                adds += [np.full(len(moved), -1.0), more[linked]]
            u, v, add = (np.concatenate(a) for a in (us, vs, adds))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=add >= 0), pa.array(add.astype(np.int64))], ["u", "v", "links"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                table = pa.Table.from_batches(held)
                key = table.column("block").to_numpy().astype(np.int64) << 32 | table.column("part").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from answer(table.slice(0, cut), key[:cut])
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            table = pa.Table.from_batches(held)
            yield from answer(table, table.column("block").to_numpy().astype(np.int64) << 32 | table.column("part").to_numpy())

    dealt = members.mapInArrow(visits, "block int, part int, own boolean, cell int, rep long, n long, vec binary, visits binary")
    dealt = dealt.repartition(partitions(spark), "block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(search, "u long, v long, links long")


def hash_part(rep: int, parts: int) -> int:
    """Part of a large block that a class belongs to."""
    return (rep * 0x9E3779B97F4A7C15 >> 17) % parts if parts > 1 else 0


def later_part(rep: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Whether a class of the block belongs to a later part than the one that it was sent to."""
    return np.array([hash_part(r, parts) for r in rep.tolist()], np.int64) > part if parts > 1 else np.zeros(len(rep), bool)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``table(vec_id, embedding)``.

    Vectors of unlike dimensions never link. A vector that is null, zero or not finite in a component, and a row
    without an id, link with nothing and are their own component. Each of repeated rows is a vector that links with
    the others. An empty table gives an empty result.
    """
    rows = staged(vectors(table), "vectors")
    valid = rows.where(F.col("digest").isNotNull())
    classes = staged(valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    # two classes never have the same least id unless an id repeats; digests tell them apart then
    classes = staged(classes.withColumn("rep", F.xxhash64("digest")), "named")
    dims = [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]
    found = None
    for dim, n in dims:
        part = links(classes.where(F.col("dim") == dim), dim, n, threshold, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found, "links")
    nodes = staged(connected_components(found.where("v is not null").select("u", "v")), "components")
    sums = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    least = valid.groupBy("digest").agg(F.min("vec_id").alias("least"))
    labelled = classes.join(nodes, classes.rep == nodes.node, "left").join(sums, "rep", "left").join(least, "digest")
    labelled = staged(labelled.select("digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least"), "labelled")
    top = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(top, "component").select("digest", "links", "component_id")
    out = rows.join(by_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def digest(table: DataFrame) -> DataFrame:
    """Query op3."""
    return near_duplicates(table.select("vec_id", "embedding"))
