"""Facilities, contingencies and cases as objects with groups: any object family by any group with any statistic, and search in records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.columns import UNKNOWN
from casewright.operators import quantiles, ranking

STATISTICS = ("mean", "median", "low", "high", "sd", "variance", "iqr", "total")


def label(x: Column) -> Column:
    """A group's label as an array of one; blank and null are unknown."""
    return F.array(F.coalesce(F.nullif(F.trim(x.cast("string")), F.lit("")), F.lit(UNKNOWN)))


def ends(x: Column) -> Column:
    """The distinct labels of an array, in its order; unknown for none."""
    known = F.array_distinct(F.filter(F.transform(x, lambda v: F.nullif(F.trim(v.cast("string")), F.lit(""))), lambda v: v.isNotNull()))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(UNKNOWN)))


def grouped(objects: DataFrame, groups: dict[str, Column], value: Column) -> DataFrame:
    """group, label, objects (all of them, whatever their value), used (with a value) and the statistics of the value, for every group in one pass:
    an object is a row for each label it has, two for one that joins two areas. groups: arrays of labels by name."""
    tagged = lambda g: lambda x: F.struct(F.lit(g).alias("group"), x.alias("label"))
    every = F.flatten(F.array(*(F.transform(labels, tagged(g)) for g, labels in groups.items())))
    rows = objects.select(F.explode(every).alias("x"), value.cast("double").alias("_value")).select("x.group", "x.label", "_value")
    counts = rows.groupBy("group", "label").agg(F.count("*").alias("objects"))
    found = quantiles.statistics(rows, ["group", "label"], F.col("_value")).drop("q").withColumnRenamed("n", "used")
    return counts.join(found, ["group", "label"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))


def ranked(found: DataFrame, statistic: str, by: list[str]) -> DataFrame:
    """found with rank: labels within `by` by a statistic, the largest first, ties by label. Groups may have any number of labels."""
    numbered = ranking.numbered(found, [*by, F.col(statistic).desc_nulls_last(), "label"], "_number")
    firsts = numbered.groupBy(*by).agg(F.min("_number").alias("_first"))
    return numbered.join(firsts, by).withColumn("rank", F.col("_number") - F.col("_first") + 1).drop("_number", "_first")


def search(records: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """kind, record of the records that meet every word of text: a word equals one of its keys (bus numbers, id or circuit), or is part of the name of
    one of its buses. records: kind, record, keys, buses; names: bus, bus_name.

    Keys are an index of words; only the words asked for are looked up in it, a record's words are counted, and names are searched once."""
    words = sorted(set(text.lower().split()))
    if not words:
        return records.select("kind", "record")
    asked = F.array(*map(F.lit, words))
    index = records.select("kind", "record", F.explode("keys").alias("word")).select("kind", "record", F.lower(F.trim("word")).alias("word")).where(F.col("word").isin(*words))
    hit = names.select("bus", F.explode(F.filter(asked, lambda w: F.contains(F.lower("bus_name"), w))).alias("word"))
    by_name = records.select("kind", "record", F.explode("buses").alias("bus")).join(hit, "bus").select("kind", "record", "word")
    return index.union(by_name).groupBy("kind", "record").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(words)).select("kind", "record")
