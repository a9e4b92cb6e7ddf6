"""Structured Streaming forms of the running summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.columns import KEY
from casewright.operators.network import shared_path


def running_group_stats(events: DataFrame) -> DataFrame:
    """Works alike on a batch and on a stream. The state of a group is its count, exact sum, range and second moment around the mean;
    states merge, so partial results of files and batches add up."""
    value = F.col("value").cast("double")
    total = F.sum(value.cast("decimal(18,5)")).cast("double")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), total.alias("total"), (total / F.count(value)).alias("mean"), F.round(F.var_pop(value), 4).alias("variance"), F.round(F.stddev_pop(value), 6).alias("sd"))


def stream_to_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Feed the Parquet files below path to running_group_stats and return the complete result."""
    schema = spark.read.parquet(path).schema
    stream = running_group_stats(spark.readStream.schema(schema).parquet(f"{path}*"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def complete(spark: SparkSession, rows: DataFrame, running: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows as files that a stream takes in turn; every batch writes the whole running result to the shared folder,
    and the last one is returned."""
    source, out, last = shared_path(spark, "stream"), shared_path(spark, "running"), []
    rows.write.parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last[:] = [number]

    stream = running(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source))
    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[0]}") if last else running(rows)
