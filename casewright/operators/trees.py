"""Spanning trees and the outages that split a network, in a logarithmic number of rounds.

Every round is a few joins whose result is written to the shared folder. A spanning forest grows by every part taking its outgoing element with the
smallest number; parts that took one another become one, and labels follow pointers that double. The forest's Euler tour (each element
once in each direction) is ranked by doubling pointers that carry their length, which gives parents, subtree sizes and an order in which every subtree
is a range. Sums over a subtree then are differences of running sums, and the lowest and highest place that any other element reaches from
a subtree come from minima over ranges of doubling length. A tree element splits the network if nothing leaves the subtree below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators import ranking
from casewright.operators.network import settle


@dataclass
class Rooted:
    """nodes: bus, root (its part's smallest bus), parent, id and ckt of the element to it (null at a root), pre (place in the order, from 1), size (of its
    subtree). edges: id, a, b, ckt, tree (whether the element is part of the forest). rounds: how many were needed, by kind."""

    nodes: DataFrame
    edges: DataFrame
    rounds: dict[str, int]


def _jumped(up: DataFrame) -> tuple[DataFrame, int]:
    """l and its end of pointers (l, to), of which ends point at themselves: every round follows three pointers at once."""
    rounds = 0
    while True:
        rounds += 1
        step = up.alias("x").join(up.alias("y"), F.expr("x.to = y.l")).select("x.l", F.col("x.to").alias("was"), F.col("y.to").alias("to"))
        step = settle(step.alias("x").join(up.alias("y"), F.expr("x.to = y.l")).select("x.l", "x.was", F.col("y.to").alias("to")))
        up = step.select("l", "to")
        if step.where("was <> to").isEmpty():
            return up, rounds


def forest(edges: DataFrame, buses: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(ids of a spanning forest's elements, bus and root of every bus, rounds). edges: id, a, b with distinct ids and a <> b."""
    parts, live, chosen, rounds = buses.select("bus", F.col("bus").alias("root")), edges.select("id", F.col("a").alias("p"), F.col("b").alias("q")), None, 0
    while not live.isEmpty():
        both = live.select("id", F.col("p").alias("l"), F.col("q").alias("to")).union(live.select("id", "q", "p"))
        picks = settle(both.groupBy("l").agg(F.min(F.struct("id", "to")).alias("x")).select("l", "x.id", "x.to"))
        # numbers are distinct, so parts only point in a circle where two of them took the same element
        mutual = picks.alias("x").join(picks.alias("y"), F.expr("x.to = y.l AND x.id = y.id AND x.l < y.l")).select(F.col("x.l").alias("l"), F.col("x.l").alias("self"))
        up = settle(picks.join(mutual, "l", "left").select("l", F.coalesce("self", "to").alias("to")))
        new = picks.select("id").distinct()
        chosen = new if chosen is None else chosen.union(new)
        # parts that only are pointed at are ends of their own
        ends = up.select("to").distinct().join(up.select(F.col("l").alias("to")), "to", "left_anti").select(F.col("to").alias("l"), "to")
        up, n = _jumped(settle(up.union(ends)))
        rounds += n + 1
        p, q = up.toDF("p", "pp"), up.toDF("q", "qq")
        live = settle(live.join(p, "p", "left").join(q, "q", "left").select("id", F.coalesce("pp", "p").alias("p"), F.coalesce("qq", "q").alias("q")).where("p <> q"))
        parts = parts.join(up.toDF("root", "above"), "root", "left").select("bus", F.coalesce("above", "root").alias("root"))
    parts = settle(parts)
    lows = parts.groupBy("root").agg(F.min("bus").alias("low"))
    none = edges.select("id").limit(0)
    return settle(none if chosen is None else chosen), settle(parts.join(lows, "root").select("bus", F.col("low").alias("root"))), rounds


def _ranked(arcs: DataFrame) -> tuple[DataFrame, int]:
    """key and d, the number of arcs after it, of arcs (key, next); a round doubles pointers twice."""
    now, rounds = arcs.select("key", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("d")), 0
    while True:
        rounds += 1
        for _ in range(2):
            x, y = now.alias("x"), now.alias("y")
            now = x.join(y, F.expr("x.next = y.key"), "left").select("x.key", F.col("y.next").alias("next"), (F.col("x.d") + F.coalesce("y.d", F.lit(0))).alias("d"))
        now = settle(now)
        if now.where("next IS NOT NULL").isEmpty():
            return now.select("key", "d"), rounds


def rooted(elements: DataFrame, buses: DataFrame) -> Rooted:
    """The network's forest, each tree rooted at its smallest bus. elements: i, j, ckt, all between the given buses; buses: bus.
    A bus's elements are put in order in one task."""
    edges = settle(ranking.numbered(elements.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"), "ckt"), ["a", "b", "ckt"], "id"))
    ids, parts, grown = forest(edges, buses)
    edges = settle(edges.join(ids.withColumn("tree", F.lit(True)), "id", "left").withColumn("tree", F.coalesce("tree", F.lit(False))))
    tree = edges.where("tree")
    # an arc leaves `bus` for `to`; its twin is the same element the other way
    arcs = tree.select((F.col("id") * 2).alias("key"), (F.col("id") * 2 + 1).alias("twin"), F.col("a").alias("bus"), F.col("b").alias("to"), "id", "ckt")
    arcs = settle(arcs.union(tree.select(F.col("id") * 2 + 1, F.col("id") * 2, "b", "a", "id", "ckt")).join(parts, "bus"))
    around = Window.partitionBy("bus").orderBy("key")
    # after an arc into a bus comes the bus's next arc out; the tour ends where it would begin again at the root
    turn = F.coalesce(F.lead("key").over(around), F.when(F.col("bus") != F.col("root"), F.first("key").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ranks, toured = _ranked(settle(arcs.select(F.col("twin").alias("key"), turn.alias("next"))))
    down = arcs.join(ranks, "key").join(ranks.toDF("twin", "back"), "twin").where("d > back")
    found = down.select(F.col("to").alias("bus"), "root", F.col("bus").alias("parent"), "id", "ckt", "d", ((F.col("d") - F.col("back") + 1) / 2).cast("long").alias("size"))
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    tops = parts.where("bus = root").join(sizes, "root").select("bus", "root", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("ckt"), F.lit(None).cast("long").alias("d"), "size")
    nodes = settle(ranking.numbered(found.select(*tops.columns).union(tops), ["root", F.desc_nulls_first("d")], "pre").drop("d"))
    return Rooted(nodes, edges, {"forest": grown, "tour": toured})


def splitting(net: Rooted) -> DataFrame:
    """bus, parent, ckt, pre, size of the tree elements (from bus up to parent) whose outage splits the network. Parallel circuits are elements of their
    own, so neither of two splits."""
    at = net.nodes.select("bus", "pre")
    other = net.edges.where("NOT tree").select("a", "b").join(at.toDF("a", "pa"), "a").join(at.toDF("b", "pb"), "b")
    reach = other.select(F.col("pa").alias("pre"), F.col("pb").alias("r")).union(other.select("pb", "pa")).groupBy("pre").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    table = settle(net.nodes.select("pre").join(reach, "pre", "left").select("pre", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi")))
    inner = settle(net.nodes.where("parent IS NOT NULL").select("bus", "parent", "ckt", "pre", "size", (F.length(F.bin("size")) - 1).alias("k")))
    most, out, length = inner.agg(F.max("k")).first()[0], None, 1
    for k in range(0 if most is None else most + 1):
        x, y = table.toDF("pre", "lo", "hi"), table.toDF("last", "lo2", "hi2")
        mine = inner.where(F.col("k") == k).withColumn("last", F.col("pre") + F.col("size") - length).join(x, "pre").join(y, "last")
        mine = mine.where(F.expr("least(lo, lo2) >= pre AND greatest(hi, hi2) < pre + size")).select("bus", "parent", "ckt", "pre", "size")
        out = mine if out is None else out.union(mine)
        if k < most:  # a range twice as long is two ranges
            table = settle(x.join(table.select((F.col("pre") - length).alias("pre"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "pre", "left").select("pre", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")))
            length *= 2
    net.rounds["ranges"] = 0 if most is None else most
    return inner.select("bus", "parent", "ckt", "pre", "size").limit(0) if out is None else out


def subtree_sums(net: Rooted, facts: DataFrame, names: list[str]) -> DataFrame:
    """bus, pre, root and the sums of names over each bus's subtree: differences of running sums in the nodes' order. facts: bus and names."""
    placed = net.nodes.select("bus", "root", "pre", "size").join(facts, "bus")
    sums = placed
    parts = ranking.by_range(sums, ["pre"])
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    earlier = parts.groupBy("_part").agg(*(F.sum(c).alias(c) for c in names)).select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in names))
    upto = settle(parts.join(F.broadcast(earlier), "_part").select("bus", "root", "pre", "size", *names, *((F.col(f"b_{c}") + F.sum(c).over(own)).alias(f"u_{c}") for c in names)))
    last = upto.select(F.col("pre").alias("last"), *(F.col(f"u_{c}").alias(f"l_{c}") for c in names))
    return upto.withColumn("last", F.col("pre") + F.col("size") - 1).join(last, "last").select("bus", "root", "pre", *((F.col(f"l_{c}") - F.col(f"u_{c}") + F.col(c)).alias(c) for c in names))


def cut_off(net: Rooted, buses: DataFrame, bridges: DataFrame, swing: bool = False) -> DataFrame:
    """For each splitting element: buses, load and generation of the part cut off and of the rest.

    The part cut off is the smaller side; of equal ones the one without a swing bus, else the one below in the tree, away from the part's smallest
    bus. Nodes below zero (stars) are no buses. With swing, has_swing says whether the part cut off holds a swing bus."""
    exact = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,5)").alias(c)
    names = ["n", "load_mw", "generation_mw", "swing"]
    facts = buses.select("bus", F.expr("CAST(bus >= 0 AS BIGINT)").alias("n"), exact("load_mw"), exact("generation_mw"), F.expr("CAST(ide = 3 AS BIGINT)").alias("swing"))
    sums = settle(subtree_sums(net, facts, names))
    whole = sums.where("bus = root").select("root", *(F.col(c).alias(f"all_{c}") for c in names))
    sides = bridges.select("bus", "parent", "ckt").join(sums, "bus").join(whole, "root").where("n > 0 AND all_n > n")
    under = F.expr("n < all_n - n OR (n = all_n - n AND (swing = 0 OR all_swing - swing > 0))")
    part = lambda c, mine: F.when(under == F.lit(mine), F.col(c)).otherwise(F.col(f"all_{c}") - F.col(c))
    return sides.select(F.least("bus", "parent").alias("i"), F.greatest("bus", "parent").alias("j"), "ckt", part("n", True).alias("buses"), part("load_mw", True).cast("double").alias("load_mw"),
        part("generation_mw", True).cast("double").alias("generation_mw"), part("n", False).alias("rest_buses"), part("load_mw", False).cast("double").alias("rest_load_mw"), *([(part("swing", True) > 0).alias("has_swing")] if swing else []))
