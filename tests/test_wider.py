"""Outages, edits, documents and streams on small literals."""

import duckdb
from pyspark.sql import functions as F

from casewright.operators import edits, master, outages, summaries, trees
from casewright.plans.queries import ORACLE
from casewright.sources import documents
from casewright.streaming import streams

NET = [(1, 2, "1"), (2, 3, "1"), (3, 1, "1"), (3, 4, "1"), (4, 5, "1"), (4, 5, "2"), (5, 6, "1")]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _net(spark):
    elements = spark.createDataFrame(NET, "i long, j long, ckt string")
    return elements, trees.rooted(elements, spark.createDataFrame([(b,) for b in range(1, 7)], "bus long"))


def test_rings_and_parallel_circuits_do_not_split(spark):
    _, net = _net(spark)
    assert _rows(trees.splitting(net).select("parent", "bus", "ckt")) == [(3, 4, "1"), (5, 6, "1")]


def test_cut_off_part_is_the_smaller_side_or_the_one_without_a_swing_bus(spark):
    _, net = _net(spark)
    buses = spark.createDataFrame([(b, 3 if b == 5 else 1, 10.0 * b, 1.0) for b in range(1, 7)], "bus long, ide int, load_mw double, generation_mw double")
    got = trees.cut_off(net, buses, trees.splitting(net)).select("i", "j", "buses", "load_mw", "rest_buses", "rest_load_mw")
    assert _rows(got) == [(3, 4, 3, 60.0, 3, 150.0), (5, 6, 1, 60.0, 5, 150.0)]


def test_path_to_a_bus_and_to_an_unknown_one(spark):
    elements, _ = _net(spark)
    tree = outages.forest(elements, spark.createDataFrame([(1,)], "bus long"))
    assert [r.bus for r in outages.path(tree, 6).orderBy("step").collect()] == [1, 3, 4, 5, 6]
    assert outages.path(tree, 99).isEmpty()


def test_an_empty_network_has_no_tree_and_no_splits(spark):
    elements, none = spark.createDataFrame([], "i long, j long, ckt string"), spark.createDataFrame([], "bus long")
    assert outages.forest(elements, none).isEmpty() and trees.splitting(trees.rooted(elements, none)).isEmpty()


def test_later_changes_win_from_either_end(spark):
    elements = spark.createDataFrame([(1, 2, "1", 1), (2, 3, "1", 1)], "i long, j long, ckt string, st int")
    changes = spark.createDataFrame([(2, 1, "1", 1, {"st": "0"}), (1, 2, "1", 2, {"st": "5"}), (9, 9, "1", 3, {"st": "7"})], "i long, j long, ckt string, seq int, values map<string,string>")
    after = edits.set_fields(elements, changes, ["st"])
    assert _rows(after) == [(1, 2, "1", 5), (2, 3, "1", 1)]
    assert _rows(edits.describe(elements, after, ["i", "j", "ckt"], ["st"])) == [(1, 2, "1", "st", "1", "5")]


def test_new_circuits_take_the_smallest_free_numbers(spark):
    elements = spark.createDataFrame([(1, 2, "1", 1), (2, 1, "3", 1), (1, 2, "A", 1)], "i long, j long, ckt string, st int")
    wanted = spark.createDataFrame([(2, 1), (1, 2), (4, 5)], "i long, j long")
    assert sorted((r.i, r.ckt) for r in edits.add_circuits(elements, wanted).subtract(elements).collect()) == [(1, "2"), (1, "4"), (4, "1")]


def test_area_names_that_fit_several_areas_have_none(spark):
    areas = spark.createDataFrame([(1, "North"), (2, "Northeast"), (3, "South")], "area int, area_name string")
    wanted = spark.createDataFrame([("north",), ("Nor",), ("Southern",), ("x",)], "name string")
    assert _rows(edits.area_by_name(areas, wanted)) == [("Southern", 3), ("north", 1)]


def test_overlay_skips_blank_values(spark):
    seen = spark.createDataFrame([(1, 2, "1", "", "a"), (1, 3, "1", "s", "b")], "from_bus int, to_bus int, line_id string, section string, kind string")
    given = spark.createDataFrame([(1, 2, "1", " "), (1, 3, "1", "c")], "from_bus int, to_bus int, line_id string, kind string")
    assert [r.kind for r in master.overlay(seen, given, ["kind"]).orderBy("to_bus").collect()] == ["a", "c"]


def test_json_leaves_of_nested_values_and_of_text_that_is_no_json(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, "{"), (3, None)], "k int, t string")
    assert _rows(documents.json_leaves(df, "k", "t")) == [(1, "$.a[0]", "1"), (1, "$.a[1].b", None), (1, "$.c", "x")]


def test_page_text_marks_headings_and_drops_scripts(spark):
    df = spark.createDataFrame([("<title> T </title><h1>Head</h1><p>a &amp; b<br>c</p><script>x()</script>",), (None,)], "h string")
    got = df.select(documents.html_title(F.col("h")), documents.html_text(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("T", "# Head\na & b\nc"), ("", "")]


def test_passages_begin_at_headings_and_keep_every_character(spark):
    text = "\n".join(["# one", "x" * 300, "# two", "B. Part of two", "y" * 1000, "z" * 300, "end", ""])
    got = documents.passages(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("passage").collect()
    assert [(r.passage, r.section, r.body) for r in got] == [(1, "one", "# one\n" + "x" * 300), (2, "B. Part of two", "# two\nB. Part of two\n" + "y" * 1000), (3, "B. Part of two", "z" * 300 + "\nend")]


def test_running_summary_of_an_empty_stream(spark):
    rows = spark.createDataFrame([], "event_idx int, contingency string, from_bus int, to_bus int, line_id string, section string, viol int, rate_mva double, loading_percent double")
    assert streams.complete(spark, rows, summaries.running_contingencies).isEmpty() and streams.complete(spark, rows, summaries.running_branches).isEmpty()


def test_the_sql_of_the_shortest_path_has_no_longest_way():
    """A chain of 40 buses: its last bus is 39 elements from the first."""
    _, start, body = ORACLE["shortest_path"].partition("SELECT * FROM (WITH RECURSIVE")
    con = duckdb.connect()
    con.execute("CREATE TABLE net_bus AS SELECT b AS bus, 1 AS ide FROM range(1, 41) r(b)")
    con.execute("CREATE TABLE net_element AS SELECT b AS i, b - 1 AS j, '1' AS ckt, 1 AS st FROM range(2, 41) r(b)")
    assert sorted(con.execute(start + body).fetchall()) == [(b - 1, b, "1" if b > 1 else None) for b in range(1, 41)]
