"""The network of a RAW case: branches, two-winding transformers, and three-winding ones as windings that meet at a star node.

A star is a node with a negative number, so a way through it is one element between two buses: stepping onto a star costs nothing. Stars
have three windings at most, so their pairs of buses are written out beside the plain elements, and every search runs over buses alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators import network, ranking
from casewright.operators.network import settle

#: The winding that a three-winding transformer's status takes out of service.
OFF = {"2": 2, "3": 3, "4": 1}
#: How many buses a description of an island names.
LISTED = 10


def _name(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def elements(buses: DataFrame, branches: DataFrame, transformers: DataFrame) -> DataFrame:
    """kind, bus, end (a bus, or a star below zero), ckt, label, outage (empty for a winding) of what is in service between live buses.

    buses: bus, ide. branches: i, j, ckt, st. transformers: i, j, k (0 with two windings), circuit, status. Elements at a bus that is isolated
    (type 4) or unknown are left out; of a three-winding transformer only the windings at such buses are."""
    live = settle(buses.where("ide <> 4").select("bus").distinct())
    at = lambda df, c: df.join(live.toDF(c), c, "left_semi")
    plain = branches.where("st <> 0").select(F.lit("branch").alias("kind"), "i", "j", "ckt")
    two = transformers.where("k = 0 AND status <> '0'").select(F.lit("transformer").alias("kind"), "i", "j", F.col("circuit").alias("ckt"))
    both = at(at(plain.unionByName(two), "i"), "j")
    title = F.concat(F.initcap("kind"), F.lit(" "))
    flat = both.select("kind", F.col("i").alias("bus"), F.col("j").alias("end"), "ckt", F.concat(title, _name(F.col("i"), " to ", F.col("j"), " circuit ", F.col("ckt"))).alias("label"), _name("BR_", F.col("i"), "_", F.col("j"), "_", F.col("ckt")).alias("outage"))
    numbered = ranking.numbered(transformers.where("k <> 0 AND status <> '0'").select("i", "j", "k", "circuit", "status"), ["i", "j", "k", "circuit", "status"], "star")
    off = F.coalesce(*(F.when(F.col("status") == s, w) for s, w in OFF.items()), F.lit(0))
    wound = numbered.select("*", F.posexplode(F.array("i", "j", "k")).alias("w", "bus")).where(F.col("w") + 1 != off)
    name = _name("Transformer ", F.col("i"), "-", F.col("j"), "-", F.col("k"), " circuit ", F.col("circuit"), ", winding ", F.col("w") + 1)
    wound = at(wound.withColumn("label", name), "bus")
    return flat.union(wound.select(F.lit("transformer winding"), "bus", -F.col("star"), F.col("circuit").alias("ckt"), "label", F.lit("").alias("outage")))


def notes(buses: DataFrame, branches: DataFrame, transformers: DataFrame) -> DataFrame:
    """One row: how many buses are isolated and how many branches and transformers are out of service."""
    out = branches.agg(F.count_if(F.col("st") == 0).alias("branches")).crossJoin(transformers.agg(F.count_if(F.col("status") == "0").alias("transformers")))
    return buses.agg(F.count_if(F.col("ide") == 4).alias("isolated")).crossJoin(out).select("isolated", (F.col("branches") + F.col("transformers")).alias("out_of_service"))


def moves(found: DataFrame) -> DataFrame:
    """a, b, label: the ways from one bus to another over one element; over a star the label is that of the winding that reaches b."""
    flat = found.where("end >= 0").select(F.col("bus").alias("a"), F.col("end").alias("b"), "label")
    wound = found.where("end < 0").select("bus", "end", "label")
    over = wound.select(F.col("bus").alias("a"), "end").join(wound.select(F.col("bus").alias("b"), "end", "label"), "end").select("a", "b", "label")
    return flat.union(flat.select("b", "a", "label")).union(over).where("a <> b")


def reached(ways: DataFrame, start: list[int], k: int) -> DataFrame:
    """bus, hops, reached_from, reached_by: the buses within k elements of any start, the fewest hops, and of the ways of that many hops the
    one from the smallest bus by the first label. One join a hop; a hop's buses only meet ways, never each other."""
    spark = ways.sparkSession
    seen = front = settle(spark.createDataFrame([(b,) for b in start], "bus long").distinct().selectExpr("bus", "0 AS hops", "CAST(NULL AS BIGINT) AS reached_from", "CAST(NULL AS STRING) AS reached_by"))
    ways = settle(ways)
    for hop in range(1, k + 1):
        near = ways.join(front.select(F.col("bus").alias("a")), "a").groupBy(F.col("b").alias("bus")).agg(F.min(F.struct("a", "label")).alias("by"))
        front = settle(near.join(seen, "bus", "left_anti").select("bus", F.lit(hop).alias("hops"), F.col("by.a").alias("reached_from"), F.col("by.label").alias("reached_by")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def first_buses(members: DataFrame, group: str, label: Column) -> DataFrame:
    """group and the labels of its LISTED smallest buses, in order. Each of 64 salts of a group gives its own smallest first."""
    salted = members.select(group, "bus", label.alias("_label"), F.pmod(F.xxhash64("bus"), F.lit(64)).alias("_salt"))
    own = salted.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_salt").orderBy("bus"))).where(F.col("_n") <= LISTED)
    few = own.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("bus"))).where(F.col("_n") <= LISTED)
    return few.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", "_label"))).alias("x")).select(group, F.col("x._label").alias("first_buses"))


def islands(buses: DataFrame, found: DataFrame, area_names: DataFrame) -> DataFrame:
    """island (from 1, the largest first, then by smallest bus), bus_count, load_mw, generation_mw, has_swing_bus, areas, first_buses.

    buses: bus, bus_name, ide, area, load_mw, generation_mw; area_names: area, area_name."""
    ways = moves(found).select(F.col("a").alias("i"), F.col("b").alias("j")).distinct()
    labels = network.islands(buses, ways)
    members = settle(labels.withColumnRenamed("island", "root").join(buses.where("ide <> 4"), "bus"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,5)")).cast("double").alias(c)
    facts = members.groupBy("root").agg(F.count("*").alias("bus_count"), exact("load_mw"), exact("generation_mw"), (F.count_if(F.col("ide") == 3) > 0).alias("has_swing_bus"))
    named = members.select("root", "area").distinct().join(area_names, "area", "left")
    label = F.trim(F.concat_ws(" ", F.col("area").cast("string"), F.trim("area_name")))
    areas = named.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("area", label.alias("label")))).alias("x")).select("root", F.col("x.label").alias("areas"))
    firsts = first_buses(members, "root", F.trim(F.concat_ws(" ", F.col("bus").cast("string"), F.trim("bus_name"))))
    rows = facts.join(areas, "root").join(firsts, "root")
    return ranking.numbered(rows, [F.desc("bus_count"), "root"], "island").drop("root")


def near(found: DataFrame, hops: DataFrame) -> DataFrame:
    """label, buses, hops of the elements (transformers with three windings as one) all of whose buses are in hops (bus, hops)."""
    key = F.when(F.col("end") < 0, F.col("end").cast("string")).otherwise(F.col("label"))
    ends = found.select(key.alias("key"), F.regexp_replace("label", ", winding .*", "").alias("label"), F.explode(F.when(F.col("end") < 0, F.array("bus")).otherwise(F.array("bus", "end"))).alias("bus"))
    met = ends.join(hops.select("bus", "hops"), "bus", "left").groupBy("key", "label").agg(F.sort_array(F.collect_set("bus")).alias("buses"), F.max("hops").alias("hops"), F.count_if(F.col("hops").isNull()).alias("far"))
    return met.where("far = 0").select("label", "buses", "hops")
