"""Table reads and file sources on small literals."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import network, tables
from casewright.sources import files


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookup_takes_the_first_match_and_counts_them(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert _rows(tables.lookup(left, right, "k", ["v"], "r_")) == [(1, "a", 2), (2, None, 0)]


def test_difference_names_each_kind_and_treats_null_as_a_value(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3), ("n", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("w", 4), ("n", None)], "k string, v int")
    assert _rows(tables.difference(a, b, ["k"], "v")) == [("w", None, 4, "only after"), ("y", None, 2, "changed"), ("z", 3, None, "only before")]


def test_mixed_sort_puts_numbers_before_text_before_missing(spark):
    df = spark.createDataFrame([("b",), ("10",), (None,), ("9",), ("A",), (" ",)], "x string")
    assert [r.x for r in tables.page(df, tables.mixed_order(F.col("x")), 0, 4).collect()] == ["9", "10", "A", "b"]


def test_equal_width_bins_of_a_single_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert _rows(tables.equal_width_bins(df, "v", 10)) == [(1, 2, 2.0, 2.0)]


def test_group_any_names_blank_labels_and_counts_text(spark):
    df = spark.createDataFrame([(" ", "1"), (None, "x"), ("a", "2.5")], "g string, v string")
    assert _rows(tables.group_any(df, "g", "v")) == [("(blank)", 2, 1, 1, 1.0, 1.0), ("a", 1, 1, 0, 2.5, 2.5)]


def test_roles_and_aliases_of_headers():
    assert files.role(["From Bus", "J-Bus", "CKT", "Loading (pct)"]) == "flat"
    assert files.role(["Event Index", "event", "converged", "Status"]) == "convergence"
    assert files.role(["bus_id", "bus_name"]) == "unknown" and files.role(["bus_id", "base-kV", "Area ID"]) == "bus"
    assert files.role(["x"]) == "unknown"
    assert files.canonical_columns(["FROM_BUS", "Circuit ID"]) == {"from_bus": "FROM_BUS", "line_id": "Circuit ID"}


def test_roles_by_first_lines_without_sorting_the_others(spark, tmp_path):
    for name, text in (("a/x.csv", "I Bus,J-Bus,CKT,Loading\n1,2,3,4\n0,0,0,0\n"), ("b/x.csv", "ibus,jbus,circuit,loading\n9,9,9,9\n"), ("c.csv", "x\nibus,jbus,circuit,loading\n"), ("d.csv", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.csv_roles(spark, str(tmp_path), {})
    assert [(r.file.split(tmp_path.name)[1], r.role, r.chosen) for r in got.orderBy("file").collect()] == [("/a/x.csv", "flat", True), ("/b/x.csv", "flat", False), ("/c.csv", "unknown", False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortAggregate" in x and "min_by(value" in x]


def test_flat_rows_keep_labels_and_reject_what_is_no_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i bus,J-Bus,CKT,Loading,event\n1.0,2,01,55.5,q\n1,2,'2 ',nan,q\n1,,A,3,q\n")
    rows = files.read_flat(spark, str(tmp_path / "a.csv"))
    assert [(r.from_bus, r.to_bus, r.line_id, r.section, r.loading_percent, r.viol) for r in files.accepted(rows).collect()] == [(1, 2, "01", "", 55.5, 0)]
    assert tuple(files.reject_counts(rows).first()) == (3, 1, 2, 0, 1, 0, 1)


def test_missing_required_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ibus,jbus\n1,2\n")
    with pytest.raises(ValueError, match="line_id, loading_percent"):
        files.read_flat(spark, str(tmp_path / "a.csv"))


def test_whitespace_table_rejects_other_widths_and_types(spark):
    lines = spark.createDataFrame([("  1 2.5 a",), ("1 2.5",), ("x 2.5 a",), ("",), (None,)], "value string")
    assert _rows(files.whitespace_table(lines, [("n", "int"), ("v", "double"), ("s", "string")])) == [(1, 2.5, "a")]


def test_success_log(spark):
    lines = spark.createDataFrame([("contingency: 4 success: false violation: V warning: W",), ("contingency: 5 success: true",), ("CONTINGENCY: 6 Success: TRUE warning: Isolated",), ("other",), (None,)], "value string")
    assert _rows(files.success_log(lines)) == [(4, False, "v", False), (5, True, "none", False), (6, True, "none", True)]


def test_findings(spark):
    buses = spark.createDataFrame([(1, 1), (2, 4), (3, 1)], "bus long, ide int")
    elements = spark.createDataFrame([(1, 3, "1", 1), (3, 1, "1", 1), (1, 9, "1", 0), (3, 3, "1", 1), (1, 2, "1", 1)], "i long, j long, ckt string, st int")
    assert _rows(network.findings(buses, elements)) == [("duplicate key", 1, 3, "1"), ("isolated end", 1, 2, "1"), ("same bus", 3, 3, "1"), ("unknown bus", 1, 9, "1")]


def test_index_holds_every_case_and_finds_one_event(spark, tmp_path):
    df = spark.createDataFrame([(e, 1, e) for e in range(130)], "event_idx int, from_bus int, to_bus int")
    files.write_index(df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 130
    assert _rows(files.read_event(spark, str(tmp_path / "i"), 65)) == [(65, 1, 65)]
