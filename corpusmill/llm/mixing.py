"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words, source by source. A source's target is met by whole passes over
it, a proportional draw from each length, and a bounded-knapsack dynamic programme over the counts that is left
of the budget. Documents are then chosen, in a seeded order, by how many of each length the plan takes. Plans
are made from counts alone (one row a source and length), so no task ever holds a source's documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hashable, staged

#: Places (one a source and length) that may go to every executor; their size is counted first.
MOST_PLACES = 1 << 18
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from one row a source, ``sizes(source, source_size)``.

    The total is shared by weight; a target stops at ``most`` times its source and the excess is shared again.
    That ends where target = min(most * size, level * weight) for one level, found from running sums over the
    sources in the order in which they fill up. The two windows see one row a source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    choices = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.get(choices, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w"))
    before = Window.orderBy("fills", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("fills", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), zero),
        "open": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    }).withColumn("level", F.try_divide("left", "open"))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(whole)["level"])
    share = F.when(F.col("level").isNull() | (F.col("fills") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return ranked.select("source", "source_size", share.alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take for the largest sum that is not above ``budget``.

    Counts are split into binary parcels. Reachable sums are the bits of one integer; for each sum the parcel that
    first reached it is kept, which leads back to a choice. Ends early once the budget itself is reached.
    """
    first = np.full(budget + 1, -1, np.int32)
    parcels: list[tuple[int, int]] = []
    mask, reach = (1 << (budget + 1)) - 1, 1
    for length, count in zip(lengths, counts, strict=True):
        left, parcel = min(count, budget // length), 1
        while left > 0 and not reach >> budget & 1:
            n = min(parcel, left)
            left, parcel = left - n, parcel * 2
            new = (reach << (n * length)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")[: budget + 1]
                first[np.flatnonzero(bits)] = len(parcels)
                reach |= new
            parcels.append((length, n))
    at, taken = reach.bit_length() - 1, {}
    while at > 0:
        length, n = parcels[first[at]]
        taken[length] = taken.get(length, 0) + n
        at -= length * n
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = 3, programme: int = 1 << 16) -> tuple[int, np.ndarray]:
    """``(passes, extra)``: whole passes over a source, and how many documents of each length to take once more.

    The sum of lengths comes to the target rounded, or as near below it as the lengths allow. ``programme`` bounds
    the budget that the dynamic programme is given; what is above goes by proportion and then by size.
    """
    size = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if not size:
        return 0, extra
    passes = min(most, int(target // size))
    rest = 0 if passes >= most else int(round(target - passes * size))
    if rest >= size:
        return passes + 1, extra
    extra = np.where(lengths > 0, np.floor(counts * (rest / size)).astype(np.int64), 0)
    rest -= int((extra * lengths).sum())
    spare = np.where(lengths > 0, counts - extra, 0)
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= programme:
            break
        if lengths[i] > 0 and spare[i] > 0:
            n = min(int(spare[i]), max(0, -(-(rest - programme) // int(lengths[i]))), rest // int(lengths[i]))
            extra[i], spare[i], rest = extra[i] + n, spare[i] - n, rest - n * int(lengths[i])
    rest = min(rest, int((spare * lengths).sum()))
    # above the programme's budget nothing is usable: each length was taken whole, down to that budget, or as far as it fits
    usable = [i for i in order if spare[i] > 0 and 0 < lengths[i] <= rest]
    if not usable:
        return passes, extra
    taken = knapsack([int(lengths[i]) for i in usable], [int(spare[i]) for i in usable], rest)
    for i in usable:
        extra[i] += taken.get(int(lengths[i]), 0)
    return passes, extra


def plan(histogram: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """``(source, size, n, passes, extra)`` from the counts by source and length and the targets."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        passes, extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), most)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": pdf["source_size"], "target": pdf["target"], "passes": passes, "extra": extra})

    wanted = wanted.withColumnRenamed("source", "w_source")
    both = histogram.join(wanted, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    return both.groupBy("source").applyInPandas(solve, "source string, size long, n long, source_size long, target double, passes long, extra long")


def seeded(seed: int) -> Column:
    return F.xxhash64("doc_id", "tie", F.lit(seed))


def shares(sizes: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = 3, group: int = 512) -> DataFrame:
    """``sizes(doc_id, source, size, tie)``, each distinct row once, with ``n`` (how often it is there), ``source_size``,
    ``target``, ``passes`` (how often the mix takes each of the n) and ``again`` (how many of the n it takes once more).

    Documents of one source and length are alike to the plan; those with the lowest seeded hashes are taken. Equal rows
    are counted before they are shuffled. Groups of more than ``group`` rows are ranked in salted parts of about that
    size, which a running count puts in order.
    """
    sizes = staged(sizes.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n")), "sizes")
    histogram = staged(sizes.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "lengths")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    chosen = staged(plan(histogram, targets(totals, weights, most), most), "plan")
    same = lambda a, b: F.col(f"{a}_source").eqNullSafe(F.col(f"{b}_source")) & (F.col(f"{a}_size") == F.col(f"{b}_size"))
    named = lambda df, p: df.withColumnsRenamed({"source": f"{p}_source", "size": f"{p}_size"})
    known = named(chosen.drop("n"), "p").join(named(histogram.drop("n"), "h"), same("p", "h")).drop("h_source", "h_size")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    rows = rows.withColumn("h", seeded(seed)).withColumn("salt", F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("rows") / group))).cast("long"))
    parts = rows.where(F.col("rows") > group).groupBy("source", "size", "salt").agg(F.sum("n").alias("in_part"))
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = named(parts.withColumn("ahead", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))), "q").select("q_source", "q_size", F.col("salt").alias("q_salt"), "ahead")
    before = Window.partitionBy("source", "size", "salt").orderBy("h", F.asc_nulls_last("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.join(parts, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("salt") == F.col("q_salt")), "left")
    again = F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.col("before") - F.coalesce("ahead", F.lit(0))))
    return ranked.select("doc_id", "source", "size", "tie", "h", "n", "source_size", "target", "passes", again.alias("again"))


def mix(sizes: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = 3, group: int = 512) -> DataFrame:
    """``sizes(doc_id, source, size[, tie])`` with ``source_size``, ``target`` and ``copies``, how often the mix takes the row."""
    tie = F.col("tie") if "tie" in sizes.columns else F.lit(0).cast("long")
    each = shares(sizes.select("doc_id", "source", "size", tie.alias("tie")), seed, weights, most, group).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") + (F.col("i") <= F.col("again")).cast("long")).alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """Query op10. A null text has size 0 and takes no words; the null source is a source of its own, the last one.

    Repeated rows are rows of their own. A source without words has target 0. An empty table gives an empty result.
    """
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def sample(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows without words are not taken. What is taken once more of a source and a length are the rows before one place in the
    seeded order; rows meet that place (one a source and length) and decide by themselves. Up to MOST_PLACES places are
    broadcast, and no text is shuffled; more of them are met by a join as Spark sees fit. At the place itself there may be
    rows that are equal in all columns, of which some are taken; they become one that comes as often. Names of columns
    cannot clash.
    """
    place = F.struct("h", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*hashable(docs)).alias("tie"), F.struct("*").alias("row")).where("size > 0")
    plan = shares(keyed.select("doc_id", "source", "size", "tie"), seed).groupBy(F.col("source").alias("p_source"), F.col("size").alias("p_size"))
    plan = staged(plan.agg(F.max("passes").alias("passes"), F.max(F.when(F.col("again") > 0, F.struct(place.alias("at"), "again", "n"))).alias("last")), "places")
    places = F.broadcast(plan) if plan.count() <= MOST_PLACES else plan
    rows = keyed.withColumn("h", seeded(seed)).join(places, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    rows = rows.select("row", "tie", place.alias("at"), "passes", "last")
    whole = (F.col("at") < F.col("last.at")) | ((F.col("at") == F.col("last.at")) & (F.col("last.again") == F.col("last.n")))
    out = rows.select("row", (F.col("passes") + F.coalesce(whole.cast("long"), F.lit(0))).alias("copies"))
    if not plan.where("last.again < last.n").isEmpty():
        split = rows.where((F.col("at") == F.col("last.at")) & (F.col("last.again") < F.col("last.n"))).dropDuplicates(["at"])
        out = out.unionByName(split.select("row", F.col("last.again").alias("copies")))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
