"""Graph operators on the case network. Rounds are joins; lineage is cut by tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the cluster's shared folder, in one folder for each application. Where spark.checkpoint.dir is unset, a
    temporary folder serves a local master (as in tests); any other master is refused, as its executors wouldn't share it."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="casewright-")
        top = _LOCAL[context.applicationId]
    return f"{top.rstrip('/')}/casewright-{context.applicationId}/{kind}-{uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder; frames that read it can't be used any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rsplit("/", 1)[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read back."""
    path = shared_path(df.sparkSession, "net")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_service(buses: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements in service between two buses that aren't isolated (type 4)."""
    live = buses.where("ide <> 4").select("bus")
    return elements.where("st = 1").join(live.toDF("i"), "i", "left_semi").join(live.toDF("j"), "j", "left_semi").select("i", "j", "ckt")


def _both_ways(elements: DataFrame) -> DataFrame:
    return elements.select("i", "j").union(elements.select("j", "i")).toDF("a", "b").distinct()


def k_hop(elements: DataFrame, start: int, k: int) -> DataFrame:
    """bus, hops: buses within k elements of start. k joins, one a hop."""
    edges = _both_ways(elements)
    seen = edges.sparkSession.createDataFrame([(start, 0)], "bus long, hops int")
    front = seen
    for hop in range(1, k + 1):
        front = front.join(edges, front["bus"] == edges["a"]).select(F.col("b").alias("bus")).distinct().join(seen, "bus", "left_anti").withColumn("hops", F.lit(hop))
        seen = settle(seen.union(front))
        front = seen.where(F.col("hops") == hop)
    return seen


def islands(buses: DataFrame, elements: DataFrame) -> DataFrame:
    """bus, island: the smallest bus of the connected part. Labels spread along edges and then jump to their label's label."""
    edges = settle(_both_ways(elements))
    labels = settle(buses.where("ide <> 4").select("bus", F.col("bus").alias("island")))
    while True:
        near = edges.join(labels, edges["b"] == labels["bus"]).groupBy("a").agg(F.min("island").alias("m"))
        step = settle(labels.join(near, labels["bus"] == near["a"], "left").select("bus", F.least("island", "m").alias("island")))
        roots = step.select(F.col("bus").alias("root"), F.col("island").alias("up"))
        step = settle(step.join(roots, step["island"] == roots["root"]).select("bus", F.col("up").alias("island")))
        moved = step.join(labels.withColumnRenamed("island", "was"), "bus").where("island <> was").limit(1).count()
        labels = step
        if not moved:
            return labels


def injections(buses: DataFrame) -> DataFrame:
    return buses.where("ide <> 4").groupBy("bus").agg(F.sum("load_mw").alias("load_mw"), F.sum("generation_mw").alias("generation_mw"))


def findings(buses: DataFrame, elements: DataFrame) -> DataFrame:
    """finding, i, j, ckt: elements at unknown buses, from a bus to itself, with the key of another one, or in service at an isolated bus."""
    known, cut = buses.select("bus"), buses.where("ide = 4").select("bus")
    keys = ["i", "j", "ckt"]
    ends = lambda df: df.select(*keys, F.explode(F.array_distinct(F.array("i", "j"))).alias("bus"))
    unknown = ends(elements).join(known, "bus", "left_anti").select(F.lit("unknown bus").alias("finding"), *keys).distinct()
    same = elements.where("i = j").select(F.lit("same bus").alias("finding"), *keys)
    twice = elements.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "ckt").count().where("count > 1").select(F.lit("duplicate key").alias("finding"), *keys)
    isolated = ends(elements.where("st = 1")).join(cut, "bus", "left_semi").select(F.lit("isolated end").alias("finding"), *keys).distinct()
    return unknown.union(same).union(twice).union(isolated)
