"""Numbers and running sums over a whole ordered table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.network import settle


def by_range(df: DataFrame, order: list) -> DataFrame:
    """df sorted by range, written, with _part (its range) and _at (its place there)."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's number, from 1, in the order: the counts of earlier ranges and the place within its own."""
    parts = by_range(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of value up to and including each row: sums of earlier ranges and a window within its own."""
    parts = by_range(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(sums), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_at", "_before")
