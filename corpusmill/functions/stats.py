"""Rank statistics, confusion counts and distributions.

Ranks are prefix sums over distinct values, made in ranges of the values and put in order by the ranges' totals, so that
neither a large group nor a single one is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (-1.0, -0.5, 0.0, 0.5, 1.0)


#: Ranges of values for each shuffle partition, and the most there are.
RANGES, MOST_RANGES = 2, 1024


def in_ranges(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the range that a value lies in, of a number of ranges of about equally many rows over all groups; their
    bounds are one scalar subquery. Nulls are in the first range, NaN in the last."""
    n = min(MOST_RANGES, RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fractions = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(F.col(value), fractions, F.lit(max(10_000, 4 * n)))).alias("bounds"))
    with_bounds = df.withColumn("__bounds", bounds.scalar())
    return with_bounds.withColumn(name, F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(value))), F.lit(0))).drop("__bounds")


def _same(left: str, right: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def prefix_sums(counts: DataFrame, by: list[str], value: str, amount: str, name: str) -> DataFrame:
    """``counts``, one row for each value of a group, with the sum of ``amount`` over the group's smaller values.

    Sums inside a range are a window over that range; the ranges' totals, few rows a group, say what comes before it.
    """
    parts = in_ranges(counts, value, "__range")
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "__range").agg(F.sum(amount).alias("__total")).withColumn("__ahead", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    both = parts.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).alias("l").join(totals.alias("r"), _same("l", "r", [*by, "__range"]))
    return both.select(*[F.col(f"l.{c}") for c in counts.columns], (F.col("l.__inside") + F.col("r.__ahead")).alias(name))


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """1-based ranks by group, ties sharing their mean; ties of any number are one row until the end."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = prefix_sums(counts, by, value, "__n", "__before").withColumn(name, F.col("__before") + (F.col("__n") + 1) / 2)
    return df.alias("l").join(ranks.alias("r"), _same("l", "r", [*by, value])).select("l.*", f"r.{name}")


def pearson(x: str, y: str) -> Column:
    """Correlation from sums; null where a side does not vary (ANSI mode would raise for ``corr``)."""
    n = F.count(F.lit(1))
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))


def spearman(df: DataFrame, x: str, y: str, by: list[str], min_n: int = 2) -> DataFrame:
    """``(by.., n, rho)``; rows with a missing side are left out, rho is null below ``min_n`` rows or without variation."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranked = average_ranks(average_ranks(rows, "__x", by, "__rx"), "__y", by, "__ry")
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("__rx", "__ry").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """``(by.., n_pos, n_neg, auc)`` as a rank sum, ties counting half; null if a side is empty."""
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*by, F.col(score).cast("double").alias("__x"), F.col(positive).cast("boolean").alias("__p"))
    ranked = average_ranks(rows, "__x", by, "__r")
    out = ranked.groupBy(*by).agg(
        F.count_if("__p").alias("n_pos"), F.count_if(~F.col("__p")).alias("n_neg"), F.coalesce(F.sum(F.when(F.col("__p"), F.col("__r"))), F.lit(0.0)).alias("__s")
    )
    u = F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return out.withColumn("auc", F.try_divide(u, (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("__s")


def confusion(df: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 by group; null where a denominator is zero."""
    p, a = F.col(predicted), F.col(actual)
    out = df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.count(F.lit(1)).alias("n")
    )
    out = out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def tier_counts(df: DataFrame, by: list[str], positive: Column) -> DataFrame:
    """Rows, positives and negatives by tier."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))


def categorical_distribution(df: DataFrame, by: list[str], category: str, values: list[str]) -> DataFrame:
    """One count column for each of ``values``; other values are ignored."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(category) == v).alias(v) for v in values])


def nearest_level(x: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    """The nearest level, the first of equally near ones."""
    choices = F.array(*[F.struct(F.abs(x - level).alias("d"), F.lit(i).alias("i"), F.lit(level).alias("level")) for i, level in enumerate(levels)])
    return F.when(x.isNotNull(), F.array_min(choices)["level"])


def graded_histogram(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Counts by nearest level."""
    snapped = df.where(F.col(value).isNotNull()).select(*by, nearest_level(F.col(value), levels).alias("level"))
    return snapped.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))


def graded_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """N, mean, population deviation, least and greatest."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Where the cumulative weight first reaches half; averaged with the next value where it lands on half.

    Equal values are one row before the running sum. "On half" is within 1e-8 + 1e-5 * half.
    """
    summed = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(weight).cast("double")).alias("__w"))
    halves = summed.groupBy(*by).agg((F.sum("__w") / 2).alias("__half"))
    run = prefix_sums(summed, by, value, "__w", "__before").alias("l").join(halves.alias("r"), _same("l", "r", by))
    run = run.select(*[F.col(f"l.{c}") for c in by], F.col(f"l.{value}").alias("v"), (F.col("l.__before") + F.col("l.__w")).alias("cum"), F.col("l.__before").alias("before"), F.col("r.__half").alias("half"))
    first = F.min(F.when(F.col("cum") >= F.col("half"), F.struct("v", "cum", "half")))
    out = run.groupBy(*by).agg(first.alias("f"), F.min(F.when(F.col("before") >= F.col("half") * (1 - 1e-12), F.col("v"))).alias("next"))
    on_half = (F.abs(F.col("f.cum") - F.col("f.half")) <= 1e-8 + 1e-5 * F.abs(F.col("f.half"))) & (F.col("next") > F.col("f.v"))
    return out.select(*by, F.when(on_half, (F.col("f.v") + F.col("next")) / 2).otherwise(F.col("f.v").cast("double")).alias("weighted_median"))


def row_aggregate(values: Column, metric: str) -> Column:
    """Mean, median or least of an array without its nulls; null if nothing is left."""
    present = F.array_sort(F.filter(values.cast("array<double>"), lambda x: x.isNotNull()))
    n = F.size(present)
    total = F.aggregate(present, F.lit(0.0), lambda s, x: s + x)
    if metric == "mean":
        return F.try_divide(total, n)
    if metric == "median":
        return (F.get(present, F.floor((n - 1) / 2).cast("int")) + F.get(present, F.floor(n / 2).cast("int"))) / 2
    if metric == "min":
        return F.get(present, F.lit(0))
    raise ValueError(f"unknown metric {metric!r}")


def best_cell(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The row with the greatest value by group, the first position among equals; groups of nulls are left out."""
    names = [c for c in df.columns if c not in (*by, value, position)]
    top = F.max(F.struct(F.col(value).alias(value), (-F.col(position)).alias("__p"), *names)).alias("t")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(top).select(*by, f"t.{value}", (-F.col("t.__p")).alias(position), *[f"t.{n}" for n in names])
