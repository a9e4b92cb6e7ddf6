"""Registered queries against their SQL, and operators on small literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import network, summaries
from casewright.plans.queries import ORACLE, QUERIES
from casewright.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def _plain(row):
    return tuple(repr(round(x, 7)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toArrow(), con.execute(ORACLE[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols
    rows = lambda t: sorted(_plain(r[c] for c in cols) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_labels_keep_leading_zeros(spark):
    df = spark.createDataFrame([(" '01 ' ",), ("1",), ("A  b",)], "x string")
    assert [r[0] for r in df.select(C.canonical_label(F.col("x"))).collect()] == ["01", "1", "A b"]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1.0", "yes"), ("nan", "diverged"), ("x", "maybe"), (None, None)], "x string, b string")
    assert [tuple(r) for r in df.select(C.lenient_int(F.col("x")), C.lenient_bool(F.col("b"))).collect()] == [(1, True), (None, False), (None, None), (None, None)]


def test_binding_case_prefers_the_smaller_event_on_ties(spark):
    rows = [(e, f"c{e}", 1, 2, "1", "", 100.0, v, 0) for e, v in ((3, -120.0), (2, 120.0), (0, 50.0))]
    df = spark.createDataFrame(rows, "event_idx int, contingency string, from_bus int, to_bus int, line_id string, section string, rate_mva double, loading_percent double, viol int")
    r = summaries.branch_summary(df).first()
    assert (r.binding_contingency, r.case_count, r.thermal_count, r.overload_count, r.base_loading) == ("c2", 3, 2, 1, 50.0)


def test_islands_of_a_ring_and_a_single_bus(spark):
    buses = spark.createDataFrame([(i, 1) for i in range(1, 6)], "bus long, ide int")
    elements = spark.createDataFrame([(1, 2, "1", 1), (2, 3, "1", 1), (3, 1, "1", 1), (3, 4, "1", 0)], "i long, j long, ckt string, st int")
    got = network.islands(buses, network.in_service(buses, elements)).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
