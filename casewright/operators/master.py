"""The master table of facilities: result tables joined on the full key, outliers, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from casewright.functions.columns import KEY
from casewright.operators.network import shared_path


def joined(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of tables on the facility key; other columns get the table's name in front."""
    named = [df.select(*KEY, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in KEY)) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, list(KEY), "full"), named)


def bucketed(spark: SparkSession, tables: dict[str, DataFrame], buckets: int) -> dict[str, tuple[str, str]]:
    """Write each table bucketed and sorted by the facility key, below the shared folder; returns the tables' names in the catalog and their paths. Written
    once, every later join on the key meets them without moving a row."""
    out = {}
    for name, df in tables.items():
        path = shared_path(spark, "bucketed")
        out[name] = f"casewright_{path.rsplit('-', 1)[1]}", path
        df.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(out[name][0])
    return out


def assembled(spark: SparkSession, written: dict[str, tuple[str, str]], buckets: int, fill: dict[str, list[str]]) -> DataFrame:
    """The master of bucketed tables: every key that any of them has, with their columns (the table's name in front; those of the first one keep
    theirs), and the columns of fill taken from the first of their candidates that isn't blank. Only the keys are dealt out; tables are joined bucket by bucket.
    Tables have one row a key."""
    tables = {n: spark.table(t) for n, (t, _) in written.items()}
    keys = reduce(DataFrame.union, (spark.read.schema(tables[n].schema).parquet(path).select(*KEY) for n, (_, path) in written.items())).repartition(buckets, *KEY).distinct()
    for at, (name, df) in enumerate(tables.items()):
        side = df.select(*(F.col(k).alias(f"_{k}") for k in KEY), *(F.col(c).alias(f"{name}_{c}" if at else c) for c in df.columns if c not in KEY))
        keys = keys.join(side.hint("merge"), reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in KEY)), "left").drop(*(f"_{k}" for k in KEY))
    known = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    for column, candidates in fill.items():
        keys = keys.withColumn(column, F.coalesce(*(known(c) for c in [column, *candidates] if c in keys.columns)))
    return keys


def write_exports(master: DataFrame, reasons: Column, path: str) -> None:
    """The master as CSV in one pass, parted by whether a row is an outlier: the folder is the master, its two parts are the cleaned rows and the
    outliers, which carry their reasons."""
    out = master.withColumn("outlier_reason", reasons)
    out.withColumn("outlier", F.col("outlier_reason") != "").write.partitionBy("outlier").option("header", True).csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType, part: str = "master") -> DataFrame:
    """The master, cleaned or outliers of write_exports()."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("outlier_reason", StringType()), StructField("outlier", BooleanType())])).option("header", True).csv(path)
    return rows if part == "master" else rows.where(F.col("outlier") == (part == "outliers"))


def outlier_reasons(columns: dict[str, Column], threshold: float) -> Column:
    """Reasons joined by '; ' for values whose size exceeds the threshold; empty for none."""
    return F.concat_ws("; ", *(F.when(F.abs(c) > threshold, F.lit(name)) for name, c in columns.items()))


def overlay(observed: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """observed with fields from given (one row for each from_bus, to_bus, line_id) where those aren't blank."""
    keys = list(KEY[:3])
    side = given.select(*keys, *(F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)).alias(f"_{f}") for f in fields))
    out = observed.join(side, keys, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in observed.columns))


def observed_keys(tables: list[DataFrame]) -> DataFrame:
    """The key of every facility of any table, with the number of the first table that has it."""
    return reduce(DataFrame.union, (t.select(*KEY, F.lit(n).alias("first_table")) for n, t in enumerate(tables))).groupBy(*KEY).agg(F.min("first_table").alias("first_table"))


def binding(low: Column, high: Column, low_name: Column, high_name: Column, recorded: Column | None = None) -> Column:
    """The contingency of the larger of a minimum and a maximum by size; a recorded one wins."""
    own = F.when(F.abs(low) > F.abs(F.coalesce(high, F.lit(0.0))), low_name).otherwise(high_name)
    return own if recorded is None else F.coalesce(recorded, own)
