"""Exact quantiles of groups of any size by distributed selection.

Equal values of a group are counted before anything moves. The counts are dealt out by range of (group, value), so a group that holds most rows
lies in many tasks; sums by range say which ranges hold the wanted ranks, and only those are looked into. No task and no
buffer holds a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.ranking import by_range

QUARTILES = (0.25, 0.5, 0.75)


def counted(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """Written rows of groups, _v (a value that isn't null) and _c (how often it occurs), sorted by range."""
    counts = df.where(value.isNotNull()).groupBy(*groups, value.cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    return by_range(counts, [*groups, "_v"])


def select(counts: DataFrame, groups: list[str], fractions: tuple[float, ...]) -> DataFrame:
    """groups, n (values that aren't null) and q (the quantile of each fraction, interpolated between neighbours) of counted() rows.
    Group columns aren't null."""
    mine = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sums = counts.groupBy("_part", *groups).agg(F.sum("_c").alias("_n"))
    known = sums.withColumn("_before", F.coalesce(F.sum("_n").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(mine))
    place = [F.lit(f) * (F.col("n") - 1) for f in fractions]
    ranks = [r.cast("long") for p in place for r in (F.floor(p), F.ceil(p))]
    wanted = known.where(reduce(Column.__or__, ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")) for r in ranks)))
    rows = counts.join(wanted, ["_part", *groups])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_part", *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), F.col("_v")))
    found = rows.withColumn("_upto", upto).groupBy(*groups, "n").agg(*(at(r).alias(f"_r{i}") for i, r in enumerate(ranks)))
    low, high = lambda i: F.col(f"_r{2 * i}"), lambda i: F.col(f"_r{2 * i + 1}")
    between = [low(i) + (high(i) - low(i)) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(*groups, "n", F.array(*between).alias("q"))


def quantiles(df: DataFrame, groups: list[str], value: Column, fractions: tuple[float, ...] = QUARTILES) -> DataFrame:
    """groups, n and q of any rows."""
    return select(counted(df, groups, value), groups, fractions)


def statistics(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """groups and the nine statistics of a value: n, total, mean, median, low, high, sd, variance, iqr, and the quartiles as q. The rows are read
    once; all else comes from the counted values. Means are exact sums (five places) over n; spreads are taken around them."""
    counts = counted(df, groups, value)
    v, c = F.col("_v"), F.col("_c")
    total = F.sum(v.cast("decimal(18,5)") * c.cast("decimal(18,0)")).cast("double")
    sums = counts.groupBy(*groups).agg(F.sum(c).alias("n"), total.alias("total"), F.min(v).alias("low"), F.max(v).alias("high")).withColumn("mean", F.col("total") / F.col("n"))
    centred = counts.join(sums.select(*groups, "mean"), groups)
    spread = centred.groupBy(*groups).agg((F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(c)).alias("variance"))
    found = select(counts, groups, QUARTILES).drop("n")
    out = sums.join(spread, groups).join(found, groups)
    q = F.col("q")
    return out.select(*groups, "n", "total", "mean", q[1].alias("median"), "low", "high", F.round(F.sqrt("variance"), 6).alias("sd"), F.round("variance", 4).alias("variance"), (q[2] - q[0]).alias("iqr"), "q")
