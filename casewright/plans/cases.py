"""Registered queries over RAW cases: one case file an area, in three versions, written from the network's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import network
from casewright.plans.queries import query
from casewright.sources import raw


def _case_sql() -> str:
    line = lambda *parts: f"concat_ws(',', {', '.join(parts)})"
    rows = lambda text, test, source: f"SELECT {source[0]} AS area, {source[1]} AS at, {text} AS line FROM {source[2]} WHERE {test}"
    bus = line("bus", "concat('''', bus_name, '   ''')", "' 138.0'", "ide", "area", "1", "1", "1.01", "'-0.5'", "1.1", "0.9", "1.1", "0.9")
    load = line("concat('  ', bus)", "'''1 '''", "1", "area", "1", "load_mw")
    gen = line("bus", "'''1 '''", "generation_mw")
    front = ["i", "concat('-', j)", "concat('''', ckt, ' ''')", "'1.0E-2'", "0.05", "0.02"]
    v = "33 + e.area % 3"
    back = ["0", "0", "0", "0", "st", "1", "10.0", "1", "'1.0000 / tie, line'"]
    branch = f"CASE WHEN {v} = 33 THEN {line(*front, '100', '110', '120', *back)} ELSE {line(*front, repr('a,b'), *(['100'] * 12), *back)} END".replace("'a,b'", "'''a,b'''")
    two = "concat_ws('\\n', concat_ws(',', bus, bus + 1, 0, '''2 ''', 1, 1, 1, 0.1, 0.2, 2, concat('''T', bus, ''''), 1, 1, 1.0), '0.01,0.05,100.0', concat_ws(',', 1.0, 0.0, 0.0, bus + 0.5, 20, 30), '1.0,0.0')"
    three = "concat_ws('\\n', concat_ws(',', bus, bus + 1, bus + 2, '''3 ''', 1, 1, 1, 0.1, 0.2, 2, concat('''W', bus, ''''), 3, 1, 1.0), '0.01,0.05,100.0,0.01,0.05,100.0,0.01,0.05,100.0,1.0,0.0', concat_ws(',', 1.0, 0.0, 0.0, 11, 20, 30), concat_ws(',', 1.0, 0.0, 0.0, 12, 20, 30), concat_ws(',', 1.0, 0.0, 0.0, 13, 20, 30))"
    b, e = ("area", "bus", "net_bus"), ("e.area", "i", "(SELECT x.*, b.area FROM net_element x JOIN net_bus b ON b.bus = x.i) e")
    parts = [
        "SELECT area, 0 AS section, 0 AS at, concat(' 0, 100.00, ', 33 + area % 3, ', 0, 0, 60.00 / case') AS line FROM (SELECT DISTINCT area FROM net_bus)",
        "SELECT area, 0, 1, 'title / one' FROM (SELECT DISTINCT area FROM net_bus)", "SELECT area, 0, 2, '0 / title two' FROM (SELECT DISTINCT area FROM net_bus)"]
    sections = [("BUS", rows(bus, "true", b)), ("LOAD", rows(load, "bus % 2 = 0", b)), ("FIXED SHUNT", None), ("GENERATOR", rows(gen, "generation_mw <> 0", b)), ("BRANCH", rows(branch, "true", e)),
        ("SYSTEM SWITCHING DEVICE", None), ("TRANSFORMER", f"SELECT area, bus AS at, CASE WHEN bus % 4 = 1 THEN {two} ELSE {three} END AS line FROM net_bus WHERE bus % 2 = 1"),
        ("AREA", "SELECT area, 0 AS at, concat(area, ',', 7, ', 0.0, 10.0,''AREA ', area, '  ''') AS line FROM (SELECT DISTINCT area FROM net_bus)"), ("TWO-TERMINAL DC", None)]
    for i, (name, sql) in enumerate(sections):
        if sql:
            parts.append(f"SELECT area, {2 * i + 1}, at, line FROM ({sql})")
        then = f", BEGIN {sections[i + 1][0]} DATA" if i + 1 < len(sections) else ""
        parts.append(f"SELECT area, {2 * i + 2}, 0, '0 / END OF {name} DATA{then}' FROM (SELECT DISTINCT area FROM net_bus)")
    parts.append("SELECT area, 99, 0, 'Q' FROM (SELECT DISTINCT area FROM net_bus)")
    return " UNION ALL ".join(parts)


def _found(spark):
    """Records of the written cases, with the area of the file in its place."""
    path = network.shared_path(spark, "raw")
    text = spark.sql(_case_sql()).groupBy("area").agg(F.sort_array(F.collect_list(F.struct("section", "at", "line"))).alias("x"))
    text.select("area", F.array_join("x.line", "\n").alias("value")).repartition(4, "area").write.option("maxRecordsPerFile", 1).partitionBy("area").text(path)
    cases = raw.read_cases(spark, path).withColumn("file", F.regexp_extract("file", r"area=(\d+)", 1))
    return network.settle(raw.records(network.settle(raw.lines(cases))))


_E = "(SELECT x.*, b.area FROM net_element x JOIN net_bus b ON b.bus = x.i)"


@query(f"""SELECT CAST(area AS VARCHAR) AS file, section, count(*) AS records, CAST(sum(n) AS BIGINT) AS lines FROM (
 SELECT area, 'BUS' AS section, 1 AS n FROM net_bus UNION ALL SELECT area, 'LOAD', 1 FROM net_bus WHERE bus % 2 = 0 UNION ALL SELECT area, 'GENERATOR', 1 FROM net_bus WHERE generation_mw <> 0
 UNION ALL SELECT area, 'BRANCH', 1 FROM {_E} UNION ALL SELECT area, 'TRANSFORMER', CASE WHEN bus % 4 = 1 THEN 4 ELSE 5 END FROM net_bus WHERE bus % 2 = 1 UNION ALL SELECT DISTINCT area, 'AREA', 1 FROM net_bus) GROUP BY ALL""")
def raw_sections(spark, sf_dir):
    return _found(spark).groupBy("file", "section").agg(F.count_distinct("record").alias("records"), F.count("*").alias("lines"))


@query("""SELECT CAST(area AS VARCHAR) AS file, 'BUS' AS section, CAST(bus AS VARCHAR) AS first, 13 AS n_fields, bus_name AS name FROM net_bus
 UNION ALL SELECT CAST(area AS VARCHAR), 'LOAD', CAST(bus AS VARCHAR), 6, NULL FROM net_bus WHERE bus % 2 = 0 AND area % 3 = 0""")
def raw_named(spark, sf_dir):
    """Records by the names of their fields: buses of all versions, loads of version 33 (others have too few fields for names)."""
    out = raw.named(_found(spark)).where("section = 'BUS' OR (section = 'LOAD' AND map_contains_key(values, 'PL'))")
    return out.select("file", "section", F.expr("values['I']").alias("first"), F.size("values").alias("n_fields"), F.expr("values['NAME']").alias("name"))


@query("SELECT CAST(area AS VARCHAR) AS file, bus AS bus_id, bus_name, CAST(138 AS DOUBLE) AS base_kv, CAST(area AS BIGINT) AS area, CAST(1 AS BIGINT) AS zone, CAST(1 AS BIGINT) AS owner, CAST(1.01 AS DOUBLE) AS vm, CAST(-0.5 AS DOUBLE) AS va FROM net_bus")
def raw_bus(spark, sf_dir):
    return raw.buses(_found(spark))


@query(f"""SELECT CAST(area AS VARCHAR) AS file, CAST(i AS BIGINT) AS from_bus, CAST(j AS BIGINT) AS to_bus, ckt AS line_id, CAST(0.01 AS DOUBLE) AS r, CAST(100 AS DOUBLE) AS ratea, CAST(st AS BIGINT) AS status, CAST(10 AS DOUBLE) AS length, CAST(1 AS BIGINT) AS owner_1 FROM {_E} WHERE area % 3 = 0""")
def raw_branch(spark, sf_dir):
    """Branches of the version 33 cases: the positions of these fields are those of that version."""
    found = _found(spark).where("version = 33")
    return raw.branches(found).select("file", "from_bus", "to_bus", "line_id", "r", "ratea", "status", "length", "owner_1")


@query("SELECT DISTINCT CAST(area AS VARCHAR) AS file, CAST(area AS BIGINT) AS area, CAST(7 AS BIGINT) AS slack_bus, CAST(0 AS DOUBLE) AS pdes, CAST(10 AS DOUBLE) AS ptol, concat('AREA ', area) AS area_name FROM net_bus")
def raw_area(spark, sf_dir):
    return raw.areas(_found(spark))


@query("SELECT CAST(area AS VARCHAR) AS file, bus AS i, bus + 1 AS j, CASE WHEN bus % 4 = 1 THEN 0 ELSE bus + 2 END AS k, CASE WHEN bus % 4 = 1 THEN '2' ELSE '3' END AS circuit, CASE WHEN bus % 4 = 1 THEN '1' ELSE '3' END AS status, concat(CASE WHEN bus % 4 = 1 THEN 'T' ELSE 'W' END, bus) AS name FROM net_bus WHERE bus % 2 = 1")
def case_transformers(spark, sf_dir):
    return raw.transformers(_found(spark)).drop("record")


@query("""SELECT CAST(area AS VARCHAR) AS file, from_bus, to_bus, line_id, winding, internal_bus, ratea FROM (
 SELECT area, CASE WHEN bus % 8 = 1 THEN bus + 1 ELSE bus END AS from_bus, CASE WHEN bus % 8 = 1 THEN bus ELSE bus + 1 END AS to_bus, '2' AS line_id, '1-2' AS winding, CAST(NULL AS BIGINT) AS internal_bus, CAST(bus + 0.5 AS DOUBLE) AS ratea FROM net_bus WHERE bus % 4 = 1
 UNION ALL SELECT area, CASE WHEN w = 2 THEN 1000000 + bus ELSE bus + w - 1 END, CASE WHEN w = 2 THEN bus + w - 1 ELSE 1000000 + bus END, '3', CAST(w AS VARCHAR), 1000000 + bus, CAST(10 + w AS DOUBLE) FROM net_bus, (SELECT unnest([1, 2, 3]) AS w) WHERE bus % 8 = 3)""")
def three_winding_expand(spark, sf_dir):
    """Observed rows: two-winding ones turned for some, three-winding ones through an internal bus; for others one end is missing."""
    found = _found(spark)
    b = spark.table("net_bus")
    two = b.where("bus % 4 = 1").selectExpr("string(area) AS file", "IF(bus % 8 = 1, bus + 1, bus) AS from_bus", "IF(bus % 8 = 1, bus, bus + 1) AS to_bus", "'2' AS line_id")
    three = b.where("bus % 4 = 3").selectExpr("string(area) AS file", "bus", "explode(IF(bus % 8 = 3, array(1, 2, 3), array(1, 2))) AS w").selectExpr(
        "file", "IF(w = 2, 1000000 + bus, bus + w - 1) AS from_bus", "IF(w = 2, bus + w - 1, 1000000 + bus) AS to_bus", "'3' AS line_id")
    return raw.windings(found, two.union(three), raw.buses(found))


@query(f"""SELECT CAST(area AS VARCHAR) AS file, CAST(33 + area % 3 AS INT) AS version, section, a, b, n, status FROM (
 SELECT area, 'LOAD' AS section, CAST(bus AS VARCHAR) AS a, CAST(load_mw AS DOUBLE) AS b, 14 + [0, 3, 4][area % 3 + 1] AS n, '1' AS status FROM net_bus WHERE bus % 2 = 0
 UNION ALL SELECT area, 'GENERATOR', CAST(bus AS VARCHAR), CAST(generation_mw AS DOUBLE), 28 + [0, 1, 2][area % 3 + 1], '1' FROM net_bus WHERE generation_mw <> 0
 UNION ALL SELECT area, 'BRANCH', CAST(i AS VARCHAR), CAST(0.05 AS DOUBLE), CASE area % 3 WHEN 0 THEN 24 ELSE 34 END, CAST(st AS VARCHAR) FROM {_E})""")
def case_records_typed(spark, sf_dir):
    v = "values"
    return raw.typed(_found(spark)).select("file", "version", "section", F.expr(f"{v}['I']").alias("a"), F.expr(f"try_cast(coalesce({v}['PL'], {v}['PG'], {v}['X']) AS double)").alias("b"),
        F.size("values").alias("n"), F.expr(f"coalesce({v}['STATUS'], {v}['STAT'], {v}['ST'])").alias("status"))
