"""Reads of any table: lookups, differences, agreement, mixed sorts, first rows, carried values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions.names import join_key
from casewright.operators.ranking import running_sum


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. One aggregation with partial results instead of a sort of every group."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*keys, "_row.*")


def lookup(left: DataFrame, right: DataFrame, on: str, order: list, prefix: str) -> DataFrame:
    """Left rows with the first right row of their key; right columns are prefixed, `<prefix>matches` counts that key's rows."""
    rest = [c for c in right.columns if c != on]
    firsts = right.groupBy(on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("_n"))
    one = firsts.select(on, *(F.col(f"_row.{c}").alias(prefix + c) for c in rest), F.col("_n").alias(prefix + "matches"))
    return left.join(one, on, "left").withColumn(prefix + "matches", F.coalesce(prefix + "matches", F.lit(0).cast("long")))


@dataclass
class Lookup:
    """A table to look rows up in: its key column, the column of the rows so far that holds the key, the columns to add, and the order that
    makes one of several rows with a key the first."""

    label: str
    rows: DataFrame
    left_on: str
    right_on: str
    columns: list[str]
    order: list[str]


def lookups(left: DataFrame, chain: list[Lookup]) -> tuple[DataFrame, list[Observation]]:
    """left with the columns of every lookup in turn, a later one may use what an earlier one added; keys are compared as numbers or folded text.
    A name that is taken gets the lookup's label in front. The observations (of a lookup each: duplicates, the rows passed over for an
    earlier one with their key; then unmatched, the rows that found none) are filled in the same pass as the first action on the result."""
    seen, found = [], left
    for at, x in enumerate(chain):
        added = {c: c if c not in found.columns else f"{x.label}.{c}" for c in x.columns}
        if x.left_on not in found.columns or len({*added.values(), *found.columns}) < len(added) + len(found.columns):
            raise ValueError(f"{x.label}: {x.left_on} is no column, or one of {', '.join(added.values())} is there already")
        key, duplicates, unmatched = F.coalesce(join_key(F.col(f"`{x.right_on}`").cast("string")), F.lit("")), Observation(), Observation()
        firsts = x.rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*x.columns), F.struct(*x.order)).alias("_row"), F.count("*").alias("_n"))
        firsts = firsts.observe(duplicates, F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.col("_key").alias(f"_key{at}"), F.col("_row").alias(f"_row{at}"), F.lit(True).alias(f"_hit{at}"))
        own = F.coalesce(join_key(F.col(f"`{x.left_on}`").cast("string")), F.lit(""))
        found = found.join(firsts, own == F.col(f"_key{at}"), "left").observe(unmatched, F.count_if(F.col(f"_hit{at}").isNull()).alias("n"))
        found = found.select(*(F.col(f"`{c}`") for c in found.columns if not c.startswith("_")), *(F.col(f"_row{at}")[c].alias(name) for c, name in added.items()))
        seen += [duplicates, unmatched]
    return found, seen


def page_with_total(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """page() with total (rows of the whole table), next_offset (null on the last page) and truncated. One job: the rows are counted while
    every task keeps its best. The page, whose size the caller states, passes through the driver."""
    total = Observation()
    rows = page(df.observe(total, F.count(F.lit(1)).alias("n")), order, offset, size).collect()
    # a page beyond the end may not have read anything
    n, upto = total.get["n"] if rows else df.count(), offset + len(rows)
    out = df.sparkSession.createDataFrame(rows, df.schema)
    return out.select("*", F.lit(n).cast("long").alias("total"), F.lit(upto if upto < n else None).cast("long").alias("next_offset"), F.lit(upto < n).alias("truncated"))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs, is only in one side, or both: keys, before, after, kind."""
    joined = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_b")).join(
        after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_a")), keys, "full")
    kind = F.when(F.col("_a").isNull(), "only before").when(F.col("_b").isNull(), "only after").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "before", "after", "kind")


def agreement(one: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: keys missing from and extra in the other, and for each value its differing cells and largest difference."""
    a = one.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("_a"))
    b = other.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    cells = reduce(lambda out, v: out + [
        F.count_if(both & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).alias(f"{v}_differing"),
        F.max(F.when(both, F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")))).alias(f"{v}_largest")], values, [])
    return a.join(b, keys, "full").agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), *cells)


def mixed_order(x: Column) -> list[Column]:
    """Sort keys for text cells: numbers by value, then text without regard to case, then missing cells."""
    text = F.nullif(F.trim(x), F.lit(""))
    number = text.try_cast("double")
    return [F.when(text.isNull(), 2).when(number.isNull(), 1).otherwise(0), number, F.lower(text), text]


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """Rows offset to offset + size of the ordered table: a bounded heap for each task, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(size)


def group_any(df: DataFrame, group: str, value: str) -> DataFrame:
    """Any text column by any other: numeric cells are summed up, others counted as skipped, a blank label is named."""
    number = F.trim(value).try_cast("double")
    label = F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("(blank)"))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n_rows"), F.count(number).alias("n_numeric"), F.count_if(number.isNull()).alias("n_skipped"), F.min(number).alias("low"), F.max(number).alias("high"))


def missing_values(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Values asked for that no row has. The wanted ones are few; the rows are only tested for membership before the distinct."""
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], "value string")
    present = df.where(F.col(column).isin(*wanted)).select(F.col(column).alias("value")).distinct()
    return asked.join(present, "value", "left_anti")


def carry(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The latest known value at or before each row of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def top_categories(df: DataFrame, column: str, keep: int) -> DataFrame:
    """The most frequent values; ties by label."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(keep)


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Bins of equal width over the range, the highest edge in the last one. The range is one row."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    placed = df.where(F.col(value).isNotNull()).join(F.broadcast(ends))
    number = F.when(F.col("_high") == F.col("_low"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins) + 1))
    return placed.groupBy(number.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def top_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Share of the total that the largest ceil(rows * fraction) values hold. Equal values are counted first, so the
    ordered pass sees distinct values only."""
    v = df.where(F.col(value) >= 0).groupBy(F.col(value).cast("decimal(18,5)").alias("v")).agg(F.count("*").alias("c"))
    ranked = running_sum(v, [F.desc("v")], "c", "upto").withColumn("before", F.col("upto") - F.col("c")).join(F.broadcast(v.agg(F.ceil(F.sum("c") * F.lit(fraction)).alias("k"), F.sum(F.col("v") * F.col("c")).alias("total"))))
    held = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("before")))
    return ranked.agg(F.round((F.sum(F.col("v") * held) / F.max("total")).cast("double"), 6).alias("share"))
