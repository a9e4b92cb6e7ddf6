"""Breadth-first trees, paths and facts of outages of the case network. A search takes a round for each level; what follows its pointers doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.network import settle


def forest(elements: DataFrame, roots: DataFrame) -> DataFrame:
    """bus, parent, ckt, depth: breadth-first trees from the roots (column bus); ties go to the smallest parent, then circuit.
    Neighbours of a level lie in it or in the ones next to it, so only two levels are looked at."""
    edges = settle(elements.select(F.col("i").alias("a"), F.col("j").alias("b"), "ckt").union(elements.select("j", "i", "ckt")).where("a <> b"))
    before, front, levels = None, settle(roots.selectExpr("bus", "CAST(NULL AS BIGINT) AS parent", "CAST(NULL AS STRING) AS ckt", "0 AS depth")), []
    while not front.isEmpty():
        levels.append(front)
        near = front.select(F.col("bus").alias("a")).join(edges, "a").groupBy(F.col("b").alias("bus")).agg(F.min(F.struct("a", "ckt")).alias("by")).join(front, "bus", "left_anti")
        if before is not None:
            near = near.join(before, "bus", "left_anti")
        before, front = front, settle(near.select("bus", F.col("by.a").alias("parent"), F.col("by.ckt").alias("ckt"), F.lit(len(levels)).alias("depth")))
    return settle(reduce(DataFrame.union, levels)) if levels else front


def path(tree: DataFrame, end: int) -> DataFrame:
    """step, bus, ckt: the way from the tree's root to a bus; no rows if it isn't in the tree. Pointers to the parent double, and what is on
    the way doubles with them."""
    jump, way = settle(tree.select("bus", F.col("parent").alias("to")).where("parent IS NOT NULL")), tree.where(F.col("bus") == end).select("bus")
    while not jump.isEmpty():
        more = jump.join(way, "bus", "left_semi").select(F.col("to").alias("bus"))
        way = settle(way.union(more).distinct())
        jump = settle(jump.alias("x").join(jump.alias("y"), F.expr("x.to = y.bus")).select("x.bus", "y.to"))
    return tree.join(way, "bus", "left_semi").select(F.col("depth").alias("step"), "bus", "ckt")


def with_status(parts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Splitting outages (i, j, ckt) with the solver's status_code by the outage's name, in either direction."""
    names = parts.select("i", "j", "ckt", F.explode(F.array(F.concat_ws("_", F.lit("BR"), "i", "j", "ckt"), F.concat_ws("_", F.lit("BR"), "j", "i", "ckt"))).alias("contingency"))
    said = names.join(statuses, "contingency").groupBy("i", "j", "ckt").agg(F.min("status_code").alias("status_code"))
    return parts.join(said, ["i", "j", "ckt"], "left")


def near_elements(elements: DataFrame, hops: DataFrame) -> DataFrame:
    """i, j, ckt, hops of the elements both of whose buses are in hops (bus, hops)."""
    a, b = hops.toDF("i", "a"), hops.toDF("j", "b")
    return elements.join(a, "i").join(b, "j").select("i", "j", "ckt", F.greatest("a", "b").alias("hops"))


def left_out(buses: DataFrame, elements: DataFrame) -> DataFrame:
    """One row: buses and elements, and how many of them the network leaves out and why."""
    cut = buses.where("ide = 4").select("bus")
    at_cut = elements.where("st = 1").select("i", "j", F.monotonically_increasing_id().alias("k"))
    touching = at_cut.select("k", F.explode(F.array("i", "j")).alias("bus")).join(cut, "bus", "left_semi").agg(F.count_distinct("k").alias("at_isolated"))
    counts: list[Column] = [F.count("*").alias("elements"), F.count_if(F.col("st") != 1).alias("out_of_service")]
    return buses.agg(F.count("*").alias("buses"), F.count_if(F.col("ide") == 4).alias("isolated")).crossJoin(elements.agg(*counts)).crossJoin(touching)
