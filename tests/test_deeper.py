"""Keyed streams, star nodes, trees in logarithmic rounds, exact quantiles, lookups, masters and text tables on small literals."""

import random
import time
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import master, network, objects, quantiles, stars, summaries, tables, trees
from casewright.plans import deeper
from casewright.sources import fixtures, texttables
from casewright.streaming import progress


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LINES = [(1, 1, "Total contingencies to analyze: 40"), (1, 2, "Power flow did not converge"), (1, 3, "Controller iteration = 1"), (1, 4, "contingency: 7 success: true"), (1, 5, "Power Flow converged"),
    (1, 6, "Number of tasks: 50"), (1, 7, "Writing output files"), (1, 8, "total events 99"), (1, 9, "  "), (2, 1, "Running contingency #3"), (2, 2, "controller iteration = 001"), (2, 3, "N-1 contingencies"),
    (2, 4, "20 contingencies"), (2, 5, "contingency: 9 success: false"), (3, 1, "nothing"), (4, 1, "Controller iteration = 1"), (4, 2, "[gpu-batch p0] classified 30 cases in 0.5 s: 20 GPU, 10 CPU"), (4, 3, "contingency: 1 success: true"),
    (4, 4, "[gpu-batch p1] GPU chunk of 15 cases: 1 s"), (4, 5, "[gpu-batch p0] GPU chunk of 15 cases: 1 s"), (4, 6, "[gpu-batch p0] paths: 19 reported from the GPU, 10 on the CPU path, 1 lost")]
WANT = [(1, "solve", "postprocessing", 2, 50, None, None, 0, False), (2, "indexed", "solving", 2, 20, 9, None, 0, False), (4, "controller", "postprocessing", 30, 30, None, 20, 20, False)]


def test_progress_of_lines_split_over_batches_and_restarts(spark, tmp_path):
    schema, source, out = "run_id long, line_no long, line string", str(tmp_path / "lines"), str(tmp_path / "out")
    for at in range(0, len(LINES), 4):  # every call of follow() starts the query anew from its checkpoint
        spark.createDataFrame(LINES[at : at + 4], schema).coalesce(1).write.mode("append").parquet(source)
        got = progress.follow(spark, source, out, files=1)
    assert _rows(got) == WANT
    assert _rows(progress.summary(spark, spark.createDataFrame(LINES, schema), parts=2)) == WANT


def test_silent_runs_are_reported_once(spark, tmp_path):
    source, seen = str(tmp_path / "lines"), []
    spark.createDataFrame(LINES[:3], "run_id long, line_no long, line string").coalesce(1).write.parquet(source)
    stream = progress.running(spark.readStream.schema("run_id long, line_no long, line string").parquet(source), silence=1000)
    running = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    until = time.time() + 60
    while not any(r.silent for r in seen) and time.time() < until:
        time.sleep(0.5)
    time.sleep(2)
    running.stop()
    assert [(r.run_id, r.completed, r.silent) for r in seen] == [(1, 1, False), (1, 1, True)], seen


def test_many_runs_share_few_keys_of_state(spark, tmp_path):
    source, out = str(tmp_path / "lines"), str(tmp_path / "out")
    runs = [None, -7, *range(2**53 + 1, 2**53 + 1500)]
    lines = spark.createDataFrame([(r, n, "contingency: 5 success: true" if n else "20 contingencies") for r in runs for n in (0, 1)], "run_id long, line_no long, line string")
    lines.coalesce(1).write.parquet(source)
    assert _rows(progress.follow(spark, source, out)) == sorted(((r, "indexed", "solving", 1, 20, 5, None, 0, False) for r in runs), key=repr)
    assert spark.read.format("statestore").load(f"{out}/state").count() <= 1024


BUSES = [(b, f"Bus {b}", 4 if b == 9 else 3 if b == 1 else 1, b % 3, 10.0, 5.0 if b == 7 else 0.0) for b in range(1, 13)]
BRANCHES = [(1, 2, "1", 1), (2, 3, "1", 1), (2, 3, "2", 1), (8, 9, "1", 1), (10, 11, "1", 0), (7, 8, "1", 1), (3, 99, "1", 1)]
WOUND = [(3, 4, 0, "1", "1"), (4, 5, 6, "1", "1"), (5, 6, 7, "2", "3"), (10, 11, 12, "1", "0"), (6, 7, 0, "1", "0")]


def _stars(spark):
    buses = spark.createDataFrame(BUSES, "bus long, bus_name string, ide int, area int, load_mw double, generation_mw double")
    branches, wound = spark.createDataFrame(BRANCHES, "i long, j long, ckt string, st int"), spark.createDataFrame(WOUND, "i long, j long, k long, circuit string, status string")
    return buses, branches, wound


def test_network_with_star_nodes(spark):
    buses, branches, wound = _stars(spark)
    found = stars.elements(buses, branches, wound)
    assert _rows(found.select("kind", "bus", "end", "outage")) == sorted([("branch", 1, 2, "BR_1_2_1"), ("branch", 2, 3, "BR_2_3_1"), ("branch", 2, 3, "BR_2_3_2"), ("branch", 7, 8, "BR_7_8_1"), ("transformer", 3, 4, "BR_3_4_1"),
        *(("transformer winding", b, -1, "") for b in (4, 5, 6)), *(("transformer winding", b, -2, "") for b in (5, 6))], key=repr)
    assert tuple(stars.notes(buses, branches, wound).first()) == (1, 3)
    near = stars.reached(stars.moves(found), [1], 4)
    assert _rows(near.select("bus", "hops", "reached_from", "reached_by")) == [(1, 0, None, None), (2, 1, 1, "Branch 1 to 2 circuit 1"), (3, 2, 2, "Branch 2 to 3 circuit 1"), (4, 3, 3, "Transformer 3 to 4 circuit 1"),
        (5, 4, 4, "Transformer 4-5-6 circuit 1, winding 2"), (6, 4, 4, "Transformer 4-5-6 circuit 1, winding 3")]
    assert [r.label for r in stars.near(found, near.where("bus <> 6")).orderBy("label").collect()] == ["Branch 1 to 2 circuit 1", "Branch 2 to 3 circuit 1", "Branch 2 to 3 circuit 2", "Transformer 3 to 4 circuit 1"]
    facts = stars.islands(buses, found, spark.createDataFrame([(0, "North"), (1, " South ")], "area int, area_name string")).orderBy("island").collect()
    assert [(r.island, r.bus_count, r.load_mw, r.generation_mw, r.has_swing_bus, r.areas, r.first_buses[:2]) for r in facts] == [(1, 6, 60.0, 0.0, True, ["0 North", "1 South", "2"], ["1 Bus 1", "2 Bus 2"]), (2, 2, 20.0, 5.0, False, ["1 South", "2"], ["7 Bus 7", "8 Bus 8"]),
        *((3 + i, 1, 10.0, 0.0, False, [["1 South"], ["2"], ["0 North"]][i], [f"{b} Bus {b}"]) for i, b in enumerate((10, 11, 12)))]


def test_windings_split_as_elements_do(spark):
    """A winding that is the only way to a bus splits; one to a star that nothing else holds cuts no bus off."""
    buses, branches, wound = _stars(spark)
    more = wound.union(spark.createDataFrame([(12, 9, 99, "1", "1")], wound.schema))
    found = network.settle(stars.elements(buses, branches, more).select(F.col("bus").alias("i"), F.col("end").alias("j"), "ckt"))
    nodes = buses.where("ide <> 4").select("bus").union(found.where("j < 0").select("j")).distinct()
    facts = buses.select("bus", "ide", "load_mw", "generation_mw").union(nodes.where("bus < 0").selectExpr("bus", "0", "0D", "0D"))
    net = trees.rooted(found, nodes)
    got = trees.cut_off(net, facts, trees.splitting(net)).select("i", "j", "buses", "rest_buses")
    assert _rows(got) == sorted([(1, 2, 1, 5), (3, 4, 3, 3), (-1, 4, 2, 4), (7, 8, 1, 1)], key=repr)


def _bridges_by_force(nodes, edges):
    def parts(skip):
        up = {n: n for n in nodes}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for k, (a, b, _) in enumerate(edges):
            if k != skip:
                up[top(a)] = top(b)
        return len({top(n) for n in nodes})
    whole = parts(None)
    return sorted((min(a, b), max(a, b), c) for k, (a, b, c) in enumerate(edges) if a != b and parts(k) > whole)


def test_splitting_elements_of_random_networks(spark):
    r = random.Random(2)
    nodes, edges = [], []
    for g in range(12):  # many small networks at once: parts don't meet
        own = list(range(100 * g, 100 * g + r.randrange(1, 15)))
        nodes += own
        edges += [(r.choice(own), r.choice(own), str(k)) for k in range(r.randrange(len(own) * 2))]
    net = trees.rooted(spark.createDataFrame(edges, "i long, j long, ckt string"), spark.createDataFrame([(n,) for n in nodes], "bus long"))
    got = trees.splitting(net).select(F.least("bus", "parent"), F.greatest("bus", "parent"), "ckt").collect()
    assert sorted(map(tuple, got)) == _bridges_by_force(nodes, edges)
    rows = net.nodes.orderBy("pre").collect()
    assert [x.pre for x in rows] == list(range(1, len(nodes) + 1)) and sum(x.parent is None for x in rows) == len({x.root for x in rows})
    below = {x.bus: {y.bus for y in rows if x.pre <= y.pre < x.pre + x.size} for x in rows}
    assert all(below[x.bus] <= below[x.parent] for x in rows if x.parent is not None) and all(min(below[x.bus]) == x.bus for x in rows if x.parent is None)


def test_a_long_chain_takes_logarithmic_rounds(spark):
    n = 5000
    net = trees.rooted(spark.range(n - 1).selectExpr("id AS i", "id + 1 AS j", "'1' AS ckt"), spark.range(n).withColumnRenamed("id", "bus"))
    assert trees.splitting(net).count() == n - 1
    assert sum(net.rounds.values()) <= 2 * log2(n) + 8 and max(net.rounds.values()) <= 2 * log2(n), net.rounds


def test_quantiles_by_force(spark):
    r = random.Random(9)
    rows = [("hot", round(r.gauss(0, 1), 2)) for _ in range(4000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("same", 3.0)] * 50 + [(f"g{r.randrange(20)}", float(r.randrange(5))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {x.g: (x.n, x.q) for x in quantiles.quantiles(df, ["g"], F.col("v"), fractions).collect()}
    assert got.keys() == want.keys()
    for g, v in want.items():
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, fractions))
    stats = {x.label: x for x in summaries.by_group(df, "g", F.col("v")).collect()}
    for g, v in want.items():
        x = stats[g]
        assert (x.n, x.low, x.high) == (len(v), min(v), max(v)) and np.allclose([x.mean, x.median, x.variance, x.sd, x.iqr], [np.mean(v), np.median(v), np.var(v), np.std(v), np.subtract(*np.quantile(v, [0.75, 0.25]))], atol=1e-4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows into one
    counts = quantiles.counted(df, ["g"], F.col("v"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts.where("g = 'hot'").select("_part").distinct().count() > 1  # a hot group lies in several ranges
    assert quantiles.quantiles(df.limit(0), ["g"], F.col("v")).isEmpty()


def test_base_cases_violations_and_first_ratings(spark):
    names = [("Base Case", True), (" BASE-case ", True), ("basecase", True), ("base_cases", False), (None, False)]
    df = spark.createDataFrame([(n, None, w) for n, w in names] + [("x", 0, True), ("x", 1, False)], "n string, e int, want boolean")
    assert all(r.got == r.want for r in df.select("want", C.base_case(F.col("e"), F.col("n")).alias("got")).collect())
    rows = [(3, "c", 80.0, "yes", 70.0), (1, "a", -120.0, "0", None), (2, "b", 120.0, "2.5", 90.0), (5, "Base", 40.0, "n/a", 10.0), (6, "d", 99.0, None, None)]
    cases = spark.createDataFrame([(e, n, 1, 2, "1", "", rate, v, viol) for e, n, v, viol, rate in rows], "event_idx int, contingency string, from_bus int, to_bus int, line_id string, section string, rate_mva double, loading_percent double, viol string")
    r = summaries.branch_summary(cases).first()
    assert (r.rate_mva, r.base_loading, r.overload_count, r.thermal_count, r.min_event, r.max_event, r.binding_event, r.binding_contingency, r.min_deviation, r.max_deviation) == (90.0, 40.0, 2, 2, 1, 2, 1, "a", -160.0, 80.0)


def test_chained_lookups_count_and_rename(spark):
    left = spark.createDataFrame([("1.0", "x"), (" A  b", "y"), ("9", "z"), (None, "w")], "k string, name string")
    one = spark.createDataFrame([("1", "n1", 7, 1), ("1", "n2", 8, 0), ("a B", "n3", None, 0)], "id string, name string, to int, at int")
    two = spark.createDataFrame([(8, "eight"), (8, "other")], "to int, word string")
    chain = [tables.Lookup("one", one, "k", "id", ["name", "to"], ["at"]), tables.Lookup("two", two, "to", "to", ["word"], ["word"])]
    out, seen = tables.lookups(left, chain)
    assert out.columns == ["k", "name", "one.name", "to", "word"]
    assert _rows(out) == sorted([("1.0", "x", "n2", 8, "eight"), (" A  b", "y", "n3", None, None), ("9", "z", None, None, None), (None, "w", None, None, None)], key=repr)
    assert [o.get["n"] for o in seen] == [1, 2, 1, 3]
    with pytest.raises(ValueError, match="no column"):
        tables.lookups(left, [tables.Lookup("x", two, "nowhere", "to", ["word"], ["word"])])


def test_pages_know_their_total(spark):
    df = spark.range(25)
    last = tables.page_with_total(df, ["id"], 20, 10).collect()
    assert [r.id for r in last] == list(range(20, 25)) and {(r.total, r.next_offset, r.truncated) for r in last} == {(25, None, False)}
    assert {(r.total, r.next_offset, r.truncated) for r in tables.page_with_total(df, ["id"], 0, 10).collect()} == {(25, 10, True)}
    assert tables.page_with_total(df, ["id"], 90, 10).isEmpty()


def test_objects_in_several_groups(spark):
    df = spark.createDataFrame([("a", "b", 10.0), ("a", "a", 20.0), ("b", None, None), (None, None, 5.0)], "f string, t string, v double")
    got = objects.grouped(df, {"area": objects.ends(F.array("f", "t")), "f": objects.label(F.col("f"))}, F.col("v"))
    assert _rows(got.select("group", "label", "objects", "used", "mean")) == [("area", "a", 2, 2, 15.0), ("area", "b", 2, 1, 10.0), ("area", "unknown", 1, 1, 5.0), ("f", "a", 2, 2, 15.0), ("f", "b", 1, 0, None), ("f", "unknown", 1, 1, 5.0)]
    ranks = objects.ranked(got, "mean", ["group"])
    assert _rows(ranks.select("group", "rank", "label")) == [("area", 1, "a"), ("area", 2, "b"), ("area", 3, "unknown"), ("f", 1, "a"), ("f", 2, "unknown"), ("f", 3, "b")]


def test_search_needs_every_word(spark):
    records = spark.createDataFrame([("load", "1 A", ["1", "A "], [1]), ("branch", "1 22 1", ["1", "22", "1"], [1, 22]), ("branch", "3 4 2", ["3", "4", "2"], [3, 4])], "kind string, record string, keys array<string>, buses array<long>")
    names = spark.createDataFrame([(1, "North 22"), (22, "South"), (3, None), (4, "north")], "bus long, bus_name string")
    find = lambda text: [r.record for r in objects.search(records, names, text).orderBy("record").collect()]
    assert find("22 1") == ["1 22 1", "1 A"] and find("a NORTH") == ["1 A"] and find("north 2") == ["1 22 1", "1 A", "3 4 2"] and find("x") == [] and len(find(" ")) == 3


def test_bucketed_tables_are_joined_without_moving(spark):
    key = "from_bus int, to_bus int, line_id string, section string"
    a, b = spark.createDataFrame([(1, 2, "1", "", " ", 5)], f"{key}, area string, x int"), spark.createDataFrame([(1, 2, "1", "", "North", 1), (3, 4, "1", "", "South", 2)], f"{key}, area string, y int")
    out = master.assembled(spark, master.bucketed(spark, {"base": a, "one": b, "two": b.limit(0)}, 4), 4, {"area": ["one_area"]})
    assert _rows(out.select("from_bus", "area", "x", "one_y", "two_y")) == [(1, "North", 5, 1, None), (3, "South", None, 2, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1  # of the keys alone


def test_text_tables_by_their_files(spark, tmp_path):
    (tmp_path / "pgen.txt").write_text(" 1 2 A 1.5 2 3e1\n\n1 2 A 1.5 2\n1 2.0 A 1 2 3\n")
    (tmp_path / "pq_change_cnt.txt").write_text("1\t2\t3\n")
    (tmp_path / "other.txt").write_text("1 2 3\n")
    rows = texttables.lines(spark, str(tmp_path))
    assert _rows(texttables.rejects(rows)) == [("pgen", 1, 1, 1), ("pq_change_cnt", 1, 0, 0)]
    assert _rows(texttables.table(rows, "pgen")) == [(1, 2, "A", 1.5, 2.0, 30.0)] and len(texttables.SCHEMAS) == 16


def test_families_of_objects_are_read_from_what_was_written(spark):
    """Each is read several times; none repeats the joins under the cases."""
    fixtures.register(spark, "/root/testdata/sf0.001")
    for family, rows, _, _ in deeper._objects(spark):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString(), family
