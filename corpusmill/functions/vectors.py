"""Column functions over ``array<float|double>`` vectors; all arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-12


def wide(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; an expression inside a lambda is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """V2, V5: sum of products; null if either is null."""
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(wide(a), F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, by: Column) -> Column:
    return let(by, lambda b: F.transform(wide(a), lambda x: x * b))


def unit(a: Column) -> Column:
    """V1: unit length, with a floor under the norm so that a zero vector stays zero."""
    return let(wide(a), lambda v: let(F.greatest(norm(v), F.lit(FLOOR)), lambda n: F.transform(v, lambda x: x / n)))


def minus(a: Column, b: Column) -> Column:
    """V3 and V4: difference."""
    return F.zip_with(wide(a), wide(b), lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def contrast(doc: Column, pos: Column, neg: Column) -> Column:
    """V2: how much nearer a document is to one pole than to the other, by cosine."""
    return let(unit(doc), lambda d: dot(d, unit(pos)) - dot(d, unit(neg)))


def axis(pos: Column, neg: Column) -> Column:
    """V4: unit difference of the unit poles; zero where they agree."""
    return unit(minus(unit(pos), unit(neg)))


def _less(v: Column, along: Column) -> Callable[[Column], Column]:
    return lambda d: F.zip_with(v, along, lambda x, y: x - d * y)


def without_subspace(v: Column, basis: np.ndarray) -> Column:
    """V7: ``v`` less its part in the span of the orthonormal rows of ``basis`` (few rows, each one constant)."""

    def removed(w: Column) -> Column:
        out = w
        for row in basis:
            out = let(dot(w, literal(row)), _less(out, literal(row)))
        return out

    return let(wide(v), removed) if len(basis) else wide(v)


def literal(v: np.ndarray) -> Column:
    """A vector as one constant, whatever its dimension: the cast is folded when the plan is made."""
    return F.split(F.lit(",".join(map(repr, np.asarray(v, float).tolist()))), ",").cast("array<double>")


def rows_of(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list array hold a vector, and these as a matrix; they have one dimension."""
    there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    held = v.take(pa.array(there))
    values = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return there, values.reshape(len(there), len(values) // max(1, len(there)))


def mean_vector(df: DataFrame, vec: str, by: list[str]) -> DataFrame:
    """A2: component-wise mean by group as ``(by.., mean)``, without null components.

    A task adds up its vectors by group and gives out one row of sums a group (more often where it meets over 4096), so
    single components travel once a task and not once a vector.
    """
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema]
    names = [*by, "sums", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def flushed(kinds: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kinds.field(i).type) for i in range(len(by))]
            sums, counts = ([x[j] for x in held.values()] for j in (0, 1))
            out = pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64()))], names)
            held.clear()
            return out

        schema = None
        for batch in batches:
            schema = batch.schema
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by))), strict=True) if by else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                _, x = rows_of(batch.column(len(by)).take(pa.array(at)))
                if x.size:
                    known = ~np.isnan(x)
                    add = [np.where(known, x, 0.0).sum(axis=0), known.sum(axis=0)]
                    held[key] = [a + b for a, b in zip(held[key], add, strict=True)] if key in held else add
            if len(held) > 4096:
                yield flushed(schema)
        if held:
            yield flushed(schema)

    partial = df.select(*by, wide(vec).alias("v")).mapInArrow(run, ", ".join([*keys, "sums array<double>", "counts array<long>"]))
    parts = partial.select(*by, F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "x")).groupBy(*by, "i").agg(F.try_divide(F.sum("x.sums"), F.sum("x.counts")).alias("x"))
    gathered = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    return gathered.where(F.size("m") > 0).select(*by, F.col("m.x").alias("mean"))


def added(df: DataFrame, vec: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all vectors of ``part(rows)``, an array that is small and of one shape; None without vectors.

    Tasks add up their batches, about the square root of their number adds up what these give, and the driver the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = rows_of(batch.column(0))
            if x.size:
                total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["sum", "shape"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for batch in batches:
            for data, shape in zip(batch.column(0), batch.column(1), strict=True):  # noqa: B007
                x = np.frombuffer(data.as_buffer(), np.float64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([shape.as_py()], pa.list_(pa.int32()))], ["sum", "shape"])

    kind = "sum binary, shape array<int>"
    parts = df.select(wide(vec).alias("v")).mapInArrow(run, kind)
    few = max(1, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = parts.repartition(few).mapInArrow(again, kind).collect()
    return sum(np.frombuffer(r["sum"], np.float64).reshape(r["shape"]) for r in rows) if rows else None


@F.pandas_udf(T.BinaryType())
def pack(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes of a vector."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(b: pd.Series) -> pd.Series:
    """The vector of little-endian float32 bytes."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
