"""Names, cells, labels, RAW cases and ranks on small literals."""

import pytest
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import names as N
from casewright.operators import edits, outages, ranking
from casewright.sources import documents, files, raw


def _one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_names(spark):
    match = lambda q: lambda x: N.match_class(F.lit(q), x)
    assert _one(spark, match("east bernard"), "EAST BERNA~1", "EAST BERNARD", "EAST", "EASTBERNARD 12", None) == ["fuzzy", "exact", None, None, None]
    assert _one(spark, match("ea be"), "EAST BERN  ", "BERN EAST", "ea be x") == ["fuzzy", "fuzzy", "prefix"]
    assert _one(spark, match("ab"), "x ab", "AB.") == [None, "exact"]


def test_cells_and_keys(spark):
    assert _one(spark, lambda x: N.passes(x, ">", 9), "10", " 9.5 ", "n/a", "9", None) == [True, True, True, False, False]
    assert _one(spark, lambda x: N.passes(x, "in", [1, "b"]), "1.0", "B ", "2") == [True, True, False]
    assert _one(spark, N.join_key, "1.0", " 1 ", "01", "A  b", "2.5", None) == ["1", "1", "1", "a b", "2.5", ""]
    with pytest.raises(ValueError, match="unknown columns: nope"):
        N.filtered(spark.createDataFrame([(1,)], "a int"), [], ["nope"])
    with pytest.raises(ValueError, match="unknown operator"):
        N.passes(F.lit("a"), "~", 1)


def test_headings(spark):
    lines = ["## Scope  of it", "R2.1. Each Planner shall " + "x" * 200, "A. Introduction here", "Table 3.2 of things", "1.2 Limits", "1.2 limits", "Table 3; x", "plain", ""]
    assert _one(spark, N.heading, *lines) == ["Scope of it", "R2.1", "A. Introduction here", "Table 3.2 of things", "1.2 Limits", "", "", "", ""]


def test_amounts(spark):
    df = spark.createDataFrame([(None,), (0.019,), (4.25,), (192.0,), (11045.0,)], "s double")
    assert [r[0] for r in df.select(N.duration(F.col("s"))).collect()] == ["unknown", "19 ms", "4.2 s", "3 min 12 s", "3 h 4 min"]


def test_outage_names_and_labels(spark):
    assert _one(spark, C.outage_buses, "BR_1_2_1", "line_3_4", "Gen_5_1", "LD_6", "GN_x", "base_case") == [[1, 2], [3, 4], [5], [6], [], []]
    assert _one(spark, C.truthy, "yes", "0.0", "2", "off", None) == [True, False, True, False, False]
    df = spark.createDataFrame([(1, "North ", True), (2, "South", False), (3, None, True), (None, None, False)], "a int, n string, s boolean")
    assert [r[0] for r in df.select(C.end_area_label(F.col("a"), F.col("n"), F.col("s"))).collect()] == ["North (1)", "South", "3", None]


CASE = """0, 100.00, {v}, 0, 0, 60.0 / case
one
two
 1,'A, B ', 138.0,2,1,1,1,1.0,0.0
 2,'C',230,1,1,1,1,1.0,0.0 / note, more
0 / END OF BUS DATA, BEGIN LOAD DATA
 2,'01',,1,1,5.5
0 / END OF LOAD DATA, BEGIN TRANSFORMER DATA
1,2,0,'1 ',1,1,1,0,0,2,'T',1
0.1,0.2,100
1,0,0,10,20,30
1,0
1,2,-7,'2'
0.1,0.2,100,0.1,0.2,100,0.1,0.2,100,1,0
1,0,0,11,20,30
1,0,0,12,20,30
1,0,0,13,20,30
0 / END OF TRANSFORMER DATA
Q
1,2,3
"""


def test_raw_case(spark):
    cases = spark.createDataFrame([("a", CASE.format(v=33)), ("b", CASE.format(v=34)), ("empty", "")], "file string, text string")
    found = raw.records(raw.lines(cases)).where("file <> 'empty'").persist()
    assert sorted((r.section, r["count"]) for r in found.where("file = 'a' AND line = 0").groupBy("section").count().collect()) == [("BUS", 2), ("LOAD", 1), ("TRANSFORMER", 2)]
    assert sorted(tuple(r)[1:5] for r in raw.buses(found.where("file = 'a'")).collect()) == [(1, "A, B", 138.0, 1), (2, "C", 230.0, 1)]
    assert sorted(tuple(r)[2:7] for r in raw.transformers(found.where("file = 'b'")).collect()) == [(1, 2, 0, "1", "1"), (1, 2, 7, "2", "1")]
    load = {r.file: r["values"] for r in raw.typed(found).where("section = 'LOAD'").collect()}
    assert (load["a"]["ID"], load["a"]["STATUS"], load["a"]["PL"], load["a"]["SCALE"]) == ("01", "1", "5.5", "1") and load["b"]["STAT"] == "1" and load["b"]["DGENF"] == "0"
    observed = spark.createDataFrame([("a", 2, 1, "1"), ("a", 1, 99, "2"), ("a", 99, 2, "2"), ("a", 7, 99, "2"), ("a", 1, 2, "2")], "file string, from_bus long, to_bus long, line_id string")
    got = raw.windings(found.where("file = 'a'"), observed, raw.buses(found)).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(1, 99, "2", "1", 99, 11.0), (2, 1, "1", "1-2", None, 10.0), (7, 99, "2", "3", 99, 13.0), (99, 2, "2", "2", 99, 12.0)]


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "v int, i int").repartition(5)
    assert [(r.v, r.n) for r in ranking.numbered(df, ["v"], "n").orderBy("n").collect()] == [(i, i + 1) for i in range(100)]
    assert [r.s for r in ranking.running_sum(df, ["v"], "v", "s").orderBy("v").collect()] == [i * (i + 1) // 2 for i in range(100)]


def test_scaling(spark):
    buses = spark.createDataFrame([(1, 3, 1, 10.0), (2, 3, 4, 10.0), (3, 3, 1, 30.0), (4, 1, 1, 5.0)], "bus int, area int, ide int, load_mw double")
    assert [r.load_mw for r in edits.scaled(buses, 3, "load_mw", change=20.0).orderBy("bus").collect()] == [15.0, 10.0, 45.0, 5.0]
    with pytest.raises(ValueError, match="can't change"):
        edits.scaled(buses, 3, "load_mw", change=-40.0)


def test_leaves_as_deep_as_they_go(spark):
    deep = "[" * 20 + "1" + "]" * 20
    got = documents.json_leaves(spark.createDataFrame([(1, deep), (2, "no"), (3, '{"a": [true, null]}')], "k int, t string"), "k", "t").collect()
    assert sorted((r.k, r.path, r.value) for r in got if r.value) == [(1, "$" + "[0]" * 20, "1"), (3, "$.a[0]", "true")]


def test_index_is_fresh_until_its_source_changes(spark, tmp_path):
    source, path = str(tmp_path / "csv"), str(tmp_path / "index")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("event_idx,from_bus,to_bus,ckt,loading\n1,1,2,A,50\n1,1,3,A,inf\n,1,4,A,5\n")
    assert files.build_index(spark, source, lambda p: files.read_flat(spark, p), path).first().n_rows == 1
    assert files.current_index(spark, path, source)[1]
    (tmp_path / "csv" / "b.csv").write_text("event_idx,from_bus,to_bus,ckt,loading\n1,1,2,A,50\n")
    assert not files.current_index(spark, path, source)[1]


def test_outage_status_by_either_direction(spark):
    parts = spark.createDataFrame([(1, 2, "1"), (3, 4, "1")], "i int, j int, ckt string")
    said = spark.createDataFrame([("BR_2_1_1", "ISLANDED")], "contingency string, status_code string")
    assert sorted(map(tuple, outages.with_status(parts, said).collect()), key=str) == [(1, 2, "1", "ISLANDED"), (3, 4, "1", None)]
