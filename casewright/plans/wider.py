"""Further registered queries: sources and sinks, the master table, paths and outages, edits, library and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import columns as C
from casewright.operators import edits, master, network, outages, summaries, trees
from casewright.plans.more import _facilities, _sum
from casewright.plans.queries import _BRANCH, _CONTINGENCY, _DEC, _FAC, _KEYS, _USABLE, query
from casewright.sources import documents, files
from casewright.streaming import streams

# sources and sinks


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(trim(x), '^[''\"]+|[''\"]+$', '', 'g')), '\\s+', ' ', 'g') AS label FROM (SELECT p_partkey, concat(' ''', p_name, '  ', p_size, ' '' ') AS x FROM part)")
def canonical_label(spark, sf_dir):
    return spark.table("part").select("p_partkey", C.canonical_label(F.expr("concat(\" '\", p_name, '  ', p_size, \" ' \")")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS whole, CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END AS flag FROM part")
def lenient_casts(spark, sf_dir):
    text = F.expr("CASE WHEN p_size % 3 = 0 THEN 'nan' ELSE concat(' ', p_size, '.0') END")
    flag = F.expr("CASE p_size % 3 WHEN 1 THEN 'Yes ' WHEN 2 THEN 'diverged' ELSE 'maybe' END")
    return spark.table("part").select("p_partkey", C.lenient_int(text).alias("whole"), C.lenient_bool(flag).alias("flag"))


@query("SELECT event_idx, contingency, converged = 'true' AS success, CAST(iterations AS BIGINT) AS iterations FROM convergence")
def convergence_success(spark, sf_dir):
    path = network.shared_path(spark, "csv")
    spark.table("convergence").selectExpr("event_idx", "contingency", "CASE converged WHEN 'true' THEN 'OK' ELSE 'Diverged' END AS converged", "concat(iterations, '.0') AS iterations").write.option("header", True).csv(path)
    rows = spark.read.schema("event_idx string, contingency string, converged string, iterations string").option("header", True).csv(path)
    return rows.select(C.lenient_int(F.col("event_idx")).cast("int").alias("event_idx"), "contingency", C.lenient_bool(F.col("converged")).alias("success"), C.lenient_int(F.col("iterations")).alias("iterations"))


@query("SELECT n_regionkey AS area, arg_min(CASE WHEN n_nationkey % 2 = 1 THEN concat('area of ', n_name) END, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END) AS area_name FROM nation GROUP BY 1")
def area_dimension(spark, sf_dir):
    """The first name of each area that isn't blank."""
    named = spark.table("buses").select("area", "bus_id", F.expr("CASE WHEN bus_id % 2 = 1 THEN concat('area of ', bus_name) ELSE ' ' END").alias("area_name"))
    return named.groupBy("area").agg(F.min_by(F.when(F.trim("area_name") != "", F.col("area_name")), F.when(F.trim("area_name") != "", F.col("bus_id"))).alias("area_name"))


@query(r"SELECT run_id, CAST(sum(len(regexp_extract_all(lower(line), '\b(true|success|pass|passed|1)\b'))) AS BIGINT) AS success_like, CAST(sum(len(regexp_extract_all(lower(line), '\b(false|failed|fail|0)\b'))) AS BIGINT) AS failure_like FROM solver_lines GROUP BY run_id")
def token_fallback(spark, sf_dir):
    return files.token_counts(spark.table("solver_lines"), "run_id", "line")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 4")
def audit_scan(spark, sf_dir):
    """JSON lines, of which one in ten is cut short."""
    path = network.shared_path(spark, "jsonl")
    whole = F.to_json(F.struct("event_id", "user_id", "event_type"))
    spark.table("events").select(F.when(F.col("event_id") % 10 == 4, F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(path)
    return spark.read.schema("event_id long, user_id long, event_type string").option("mode", "DROPMALFORMED").json(path)


@query("SELECT event_id, '$.who.kind' AS path, event_type AS value FROM events UNION ALL SELECT event_id, '$.who.user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, concat('$.ids[', i, ']'), CAST(event_id + i AS VARCHAR) FROM events, (SELECT unnest([0, 1]) AS i)")
def json_leaves(spark, sf_dir):
    made = F.to_json(F.expr("named_struct('who', named_struct('user', user_id, 'kind', event_type), 'ids', array(event_id, event_id + 1))"))
    return documents.json_leaves(spark.table("events").select("event_id", made.alias("text")), "event_id", "text")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS network, CAST(n_regionkey AS DOUBLE) / 4 AS low, n_regionkey % 2 = 0 AS check_limits FROM nation")
def xml_settings(spark, sf_dir):
    made = F.expr("concat('<a><id>', n_nationkey, '</id><network>', n_name, '</network><limits><low>', n_regionkey / 4, '</low></limits><check>', IF(n_regionkey % 2 = 0, 'Yes', 'no'), '</check></a>')")
    path = network.shared_path(spark, "xml")
    spark.table("nation").select(made.alias("value")).write.text(path)
    x = lambda p: F.xpath_string("value", F.lit(p))
    return spark.read.text(path).select(C.lenient_int(x("a/id")).alias("n_nationkey"), x("a/network").alias("network"), C.lenient_double(x("a/limits/low")).alias("low"), C.lenient_bool(x("a/check")).alias("check_limits"))


@query("SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def text_lines(spark, sf_dir):
    lines = spark.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


@query(documents.HTML_SQL)
def html_text(spark, sf_dir):
    return spark.table("pages").select("page_id", documents.html_title(F.col("html")).alias("title"), documents.html_text(F.col("html")).alias("text"))


@query(f"SELECT event_idx, {_KEYS}, loading_percent FROM cases")
def write_parquet(spark, sf_dir):
    """Cases from CSV to Parquet; the second write finds them there and does nothing."""
    csv, path = network.shared_path(spark, "csv"), network.shared_path(spark, "parquet")
    cases = spark.table("cases").select("event_idx", *C.KEY, "loading_percent")
    cases.write.option("header", True).csv(csv)
    for _ in range(2):
        spark.read.schema(cases.schema).option("header", True).option("emptyValue", "").option("nullValue", "\u0001").csv(csv).write.mode("ignore").option("compression", "snappy").parquet(path)
    return spark.read.schema(cases.schema).parquet(path)


@query("SELECT area, area_name, 'csv' AS form FROM areas UNION ALL SELECT area, area_name, 'json' FROM areas")
def write_tables(spark, sf_dir):
    areas, csv, json = spark.table("areas"), network.shared_path(spark, "csv"), network.shared_path(spark, "json")
    areas.write.option("header", True).csv(csv)
    areas.write.json(json)
    read = spark.read.schema(areas.schema)
    return read.option("header", True).csv(csv).withColumn("form", F.lit("csv")).union(read.json(json).withColumn("form", F.lit("json")))


# master table

_FLOW = f"(SELECT {_KEYS}, max(abs(p_from_mw)) AS value FROM cases WHERE event_idx % 2 = 0 GROUP BY ALL)"
_ANGLE = f"(SELECT {_KEYS}, max(abs(ang_from_deg - ang_to_deg)) AS value FROM cases WHERE event_idx % 2 = 1 GROUP BY ALL)"
_MASTER = f"(SELECT {_KEYS}, d.rate_mva AS base_rate_mva, d.raw_branch_type AS base_raw_branch_type, p.value AS flow_value, a.value AS angle_value FROM branch_metadata d FULL JOIN {_FLOW} p USING ({_KEYS}) FULL JOIN {_ANGLE} a USING ({_KEYS}))"


def _master(spark):
    cases = spark.table("cases")
    flow = cases.where("event_idx % 2 = 0").groupBy(*C.KEY).agg(F.max(F.abs("p_from_mw")).alias("value"))
    angle = cases.where("event_idx % 2 = 1").groupBy(*C.KEY).agg(F.max(F.abs(F.col("ang_from_deg") - F.col("ang_to_deg"))).alias("value"))
    return master.joined({"base": spark.table("branch_metadata"), "flow": flow, "angle": angle})


@query(f"SELECT * FROM {_MASTER}")
def branch_master(spark, sf_dir):
    return _master(spark)


@query(f"SELECT {_KEYS}, concat_ws('; ', CASE WHEN abs(flow_value) > 20 THEN 'flow' END, CASE WHEN abs(angle_value) > 20 THEN 'angle' END) AS reasons FROM {_MASTER} WHERE flow_value > 20 OR angle_value > 20")
def master_outliers(spark, sf_dir):
    said = master.outlier_reasons({"flow": F.col("flow_value"), "angle": F.col("angle_value")}, 20)
    return _master(spark).select(*C.KEY, said.alias("reasons")).where("reasons <> ''")


@query(f"SELECT {_KEYS}, coalesce(CASE WHEN (from_bus + to_bus) % 3 = 0 THEN concat('raw ', line_id) END, raw_branch_type) AS raw_branch_type FROM branch_metadata")
def metadata_overlay(spark, sf_dir):
    seen = spark.table("branch_metadata").select(*C.KEY, "raw_branch_type")
    raw = seen.select("from_bus", "to_bus", "line_id", F.expr("IF((from_bus + to_bus) % 3 = 0, concat('raw ', line_id), ' ')").alias("raw_branch_type")).distinct()
    return master.overlay(seen, raw, ["raw_branch_type"])


@query(f"SELECT {_KEYS}, CAST(min(t) AS INT) AS first_table FROM (SELECT {_KEYS}, 0 AS t FROM cases WHERE event_idx < 20 UNION ALL SELECT {_KEYS}, 1 FROM cases_b UNION ALL SELECT {_KEYS}, 2 FROM cases) GROUP BY ALL")
def observed_keys(spark, sf_dir):
    return master.observed_keys([spark.table("cases").where("event_idx < 20"), spark.table("cases_b"), spark.table("cases")])


@query(f"SELECT {_KEYS}, CASE WHEN abs(low) > abs(coalesce(high, 0)) THEN low_name ELSE high_name END AS binding FROM (SELECT {_KEYS}, min(loading_percent) AS low, max(loading_percent) AS high, (min(struct_pack(v := loading_percent, c := contingency))).c AS low_name, (max(struct_pack(v := loading_percent, c := contingency))).c AS high_name FROM cases GROUP BY ALL)")
def legacy_binding(spark, sf_dir):
    v = F.col("loading_percent")
    ends = spark.table("cases").groupBy(*C.KEY).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.min(F.struct(v, "contingency"))["contingency"].alias("low_name"), F.max(F.struct(v, "contingency"))["contingency"].alias("high_name"))
    return ends.select(*C.KEY, master.binding(F.col("low"), F.col("high"), F.col("low_name"), F.col("high_name")).alias("binding"))


@query(f"SELECT {_KEYS}, value, a.area_name AS from_area, b.area_name AS to_area, greatest(x.base_kv, y.base_kv) AS kv, raw_branch_type AS type FROM ({_FAC}) f LEFT JOIN buses x ON x.bus_id = from_bus LEFT JOIN areas a ON a.area = x.area LEFT JOIN buses y ON y.bus_id = to_bus LEFT JOIN areas b ON b.area = y.area LEFT JOIN branch_metadata m USING ({_KEYS})")
def facility_attributes(spark, sf_dir):
    b = spark.table("buses").join(spark.table("areas"), "area", "left")
    end = lambda n: b.select(F.col("bus_id").alias(f"{n}_bus"), F.col("area_name").alias(f"{n}_area"), F.col("base_kv").alias(f"{n}_kv"))
    kinds = spark.table("branch_metadata").select(*C.KEY, F.col("raw_branch_type").alias("type"))
    out = _facilities(spark).join(end("from"), "from_bus", "left").join(end("to"), "to_bus", "left").join(kinds, list(C.KEY), "left")
    return out.select(*C.KEY, "value", "from_area", "to_area", F.greatest("from_kv", "to_kv").alias("kv"), "type")


# filters, groups and ranks


@query("SELECT from_bus, to_bus, line_id, count(*) AS n, count(CASE WHEN a.base_kv <> 500 AND b.base_kv <> 500 THEN 1 END) AS n_no_500 FROM cases JOIN buses a ON a.bus_id = from_bus JOIN buses b ON b.bus_id = to_bus WHERE a.base_kv >= 345 OR b.base_kv >= 345 GROUP BY ALL")
def two_ended_filter(spark, sf_dir):
    """A bound holds if either end meets it, a difference only if both do."""
    b = spark.table("buses").select("bus_id", "base_kv")
    ends = spark.table("cases").join(b.toDF("from_bus", "f"), "from_bus").join(b.toDF("to_bus", "t"), "to_bus").withColumn("kv", F.array("f", "t"))
    return ends.where(F.exists("kv", lambda v: v >= 345)).groupBy("from_bus", "to_bus", "line_id").agg(F.count("*").alias("n"), F.count_if(F.forall("kv", lambda v: v != 500)).alias("n_no_500"))


@query(f"SELECT {_KEYS}, value FROM ({_FAC}) JOIN buses a ON a.bus_id = from_bus JOIN buses b ON b.bus_id = to_bus WHERE (a.area IN (1, 3) OR b.area IN (1, 3)) AND greatest(a.base_kv, b.base_kv) >= 230 AND greatest(a.base_kv, b.base_kv) < 345")
def linked_selection(spark, sf_dir):
    b = spark.table("buses").select("bus_id", "area", "base_kv")
    rows = _facilities(spark).join(b.toDF("from_bus", "fa", "fk"), "from_bus").join(b.toDF("to_bus", "ta", "tk"), "to_bus")
    chosen = F.arrays_overlap(F.array("fa", "ta"), F.array(F.lit(1), F.lit(3)).cast("array<bigint>")) & (C.voltage_class(F.greatest("fk", "tk")) == "230-344 kV")
    return rows.where(chosen).select(*C.KEY, "value")


@query("SELECT i, j, ckt FROM net_element e JOIN net_bus a ON a.bus = i JOIN net_bus b ON b.bus = j WHERE (i = 7 OR j = 7 OR ckt = '7' OR contains(lower(a.bus_name), '7') OR contains(lower(b.bus_name), '7')) AND (i = 1 OR j = 1 OR ckt = '1' OR contains(lower(a.bus_name), '1') OR contains(lower(b.bus_name), '1'))")
def search_records(spark, sf_dir):
    """Records that meet every term: a bus number, a circuit, or part of a bus name."""
    names = spark.table("net_bus").select("bus", F.lower("bus_name").alias("name"))
    rows = spark.table("net_element").join(names.toDF("i", "a"), "i").join(names.toDF("j", "b"), "j")
    keys = F.array(F.col("i").cast("string"), F.col("j").cast("string"), "ckt")
    return rows.where(F.forall(F.split(F.lit("7 1"), " "), lambda t: F.array_contains(keys, t) | F.contains("a", t) | F.contains("b", t))).select("i", "j", "ckt")


@query(f"SELECT event_idx, {_KEYS}, loading_percent FROM cases ORDER BY event_idx, {_KEYS}, loading_percent LIMIT 200")
def preview_rows(spark, sf_dir):
    order = ["event_idx", *C.KEY, "loading_percent"]
    return spark.table("cases").select(*order).orderBy(*order).limit(200)


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, label, row_number() OVER (ORDER BY {o}) AS position FROM (SELECT bus_name AS label, CAST(base_kv AS DOUBLE) AS value FROM buses)" for m, o in (("up", "value, label"), ("down", "value DESC, label"), ("label", "label"))))
def sort_modes(spark, sf_dir):
    rows = spark.table("buses").select(F.col("bus_name").alias("label"), F.col("base_kv").alias("value"))
    ranked = lambda m, *o: rows.select(F.lit(m).alias("mode"), "label", F.row_number().over(Window.orderBy(*o)).cast("long").alias("position"))
    return ranked("up", "value", "label").union(ranked("down", F.desc("value"), "label")).union(ranked("label", "label"))


@query(f"SELECT count(*) AS facilities, count(CASE WHEN rate > 0 THEN 1 END) AS rated, max(value) AS highest, (min(struct_pack(v := -value, a := from_bus, b := to_bus, c := line_id, d := section))).a AS highest_from FROM ({_FAC})")
def analysis_summary(spark, sf_dir):
    at = F.min(F.struct((-F.col("value")).alias("v"), *C.KEY))
    return _facilities(spark).agg(F.count("*").alias("facilities"), F.count_if(F.col("rate") > 0).alias("rated"), F.max("value").alias("highest"), at["from_bus"].alias("highest_from"))


@query(f"SELECT a.area_name AS label, count(*) AS n, {_DEC.format('value')} / count(*) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS low, max(value) AS high FROM ({_FAC}) JOIN buses ON bus_id = from_bus JOIN areas a USING (area) GROUP BY 1")
def group_summary(spark, sf_dir):
    named = _facilities(spark).join(spark.table("buses").join(spark.table("areas"), "area"), F.col("from_bus") == F.col("bus_id"))
    return summaries.by_group(named, "area_name", F.col("value")).select("label", "n", "mean", "median", "low", "high")


@query("SELECT event_idx, contingency, violations, coalesce(converged, 'true') = 'true' AS success FROM (SELECT event_idx, contingency, count(CASE WHEN viol = 1 THEN 1 END) AS violations FROM cases GROUP BY ALL) LEFT JOIN convergence USING (event_idx, contingency) ORDER BY violations DESC, event_idx, contingency LIMIT 20")
def contingency_metrics(spark, sf_dir):
    counts = spark.table("cases").groupBy("event_idx", "contingency").agg(F.count_if(F.col("viol") == 1).alias("violations"))
    joined = counts.join(spark.table("convergence"), ["event_idx", "contingency"], "left")
    return joined.select("event_idx", "contingency", "violations", F.coalesce(C.lenient_bool(F.col("converged")), F.lit(True)).alias("success")).orderBy(F.desc("violations"), "event_idx", "contingency").limit(20)


@query("SELECT bus, abs(generation_mw - load_mw) AS deviation FROM net_bus WHERE ide = 2 ORDER BY deviation DESC, bus LIMIT 20")
def generator_deviation(spark, sf_dir):
    return spark.table("net_bus").where("ide = 2").select("bus", F.abs(F.col("generation_mw") - F.col("load_mw")).alias("deviation")).orderBy(F.desc("deviation"), "bus").limit(20)


@query(f"SELECT session, CAST(turn AS BIGINT) AS turn, tool, count(*) AS calls, {_DEC.format('seconds')} AS seconds FROM (SELECT *, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM audit) WHERE kind = 'call' AND turn > 0 GROUP BY session, turn, tool")
def turn_accounting(spark, sf_dir):
    """Calls and their seconds by turn and tool; a turn runs from a user's message to the next one."""
    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turns = spark.table("audit").withColumn("turn", F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(w)).where("kind = 'call' AND turn > 0")
    return turns.groupBy("session", "turn", "tool").agg(F.count("*").alias("calls"), _sum(F.col("seconds")).alias("seconds"))


# network

_LIVE = "(SELECT row_number() OVER (ORDER BY i, j, ckt) AS id, i, j, ckt FROM net_element WHERE st = 1 AND i <> j AND i IN (SELECT bus FROM net_bus WHERE ide <> 4) AND j IN (SELECT bus FROM net_bus WHERE ide <> 4))"
_REACH = f"""WITH RECURSIVE e AS {_LIVE}, w AS (SELECT id, i AS a, j AS b FROM e UNION ALL SELECT id, j, i FROM e),
 r(id, side, bus) AS (SELECT id, 0, i FROM e UNION ALL SELECT id, 1, j FROM e UNION SELECT r.id, r.side, w.b FROM r JOIN w ON w.a = r.bus AND w.id <> r.id),
 s AS (SELECT id, least(i, j) AS i, greatest(i, j) AS j, ckt FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = e.id AND r.side = 0 AND r.bus = e.j))"""


def _network(spark):
    buses = spark.table("net_bus")
    live = network.settle(network.in_service(buses, spark.table("net_element")))
    return buses, trees.rooted(live, buses.where("ide <> 4").select("bus"))


@query(f"SELECT * FROM ({_REACH} SELECT i, j, ckt FROM s)")
def splitting_outages(spark, sf_dir):
    _, net = _network(spark)
    return trees.splitting(net).select(F.least("bus", "parent").alias("i"), F.greatest("bus", "parent").alias("j"), "ckt")


_PARTS = f"""{_REACH}, t AS (SELECT s.id, s.i, s.j, s.ckt, r.side, count(*) AS n, sum(CAST(load_mw AS DECIMAL(18,5))) AS l, sum(CAST(generation_mw AS DECIMAL(18,5))) AS g, sum(CASE WHEN ide = 3 THEN 1 ELSE 0 END) AS swing, min(b.bus) AS low
 FROM s JOIN r USING (id) JOIN net_bus b ON b.bus = r.bus GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, CASE WHEN swing > 0 THEN 1 ELSE 0 END, low DESC) AS k FROM t)
 SELECT a.i, a.j, a.ckt, a.n AS buses, CAST(a.l AS DOUBLE) AS load_mw, CAST(a.g AS DOUBLE) AS generation_mw, b.n AS rest_buses, CAST(b.l AS DOUBLE) AS rest_load_mw FROM o a JOIN o b USING (id) WHERE a.k = 1 AND b.k = 2"""


@query(f"SELECT * FROM ({_PARTS})")
def cut_off_parts(spark, sf_dir):
    buses, net = _network(spark)
    return trees.cut_off(net, buses, trees.splitting(net))


@query(f"SELECT * FROM (WITH RECURSIVE e AS {_LIVE}, w AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e), h(bus, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT w.b, hops + 1 FROM h JOIN w ON w.a = h.bus WHERE hops < 2), m AS (SELECT bus, min(hops) AS hops FROM h GROUP BY bus) SELECT e.i, e.j, e.ckt, greatest(x.hops, y.hops) AS hops FROM e JOIN m x ON x.bus = e.i JOIN m y ON y.bus = e.j)")
def elements_near(spark, sf_dir):
    live = network.settle(network.in_service(spark.table("net_bus"), spark.table("net_element")))
    return outages.near_elements(live.where("i <> j"), network.k_hop(live, 1, 2))


@query(f"""SELECT * FROM (WITH RECURSIVE e AS {_LIVE}, w AS (SELECT i AS a, j AS b, ckt FROM e UNION SELECT j, i, ckt FROM e),
 -- a level's neighbours lie in it, in the one before or in the next one; k is 0 for the level itself, 1 for the one before
 h(bus, hops, k) AS (SELECT CAST(1 AS BIGINT), 0, 0 UNION ALL (SELECT DISTINCT w.b, hops + 1, 0 FROM h JOIN w ON w.a = h.bus WHERE k = 0 AND w.b NOT IN (SELECT bus FROM h) UNION ALL SELECT bus, hops, 1 FROM h WHERE k = 0)),
 m AS (SELECT bus, hops FROM h WHERE k = 0), p AS (SELECT b.bus, b.hops, min(struct_pack(a := w.a, c := w.ckt)) AS by FROM m b JOIN w ON w.b = b.bus JOIN m a ON a.bus = w.a AND a.hops = b.hops - 1 GROUP BY b.bus, b.hops),
 q(bus) AS (SELECT max(i) FROM e UNION SELECT p.by.a FROM q JOIN p ON p.bus = q.bus) SELECT m.hops AS step, m.bus, p.by.c AS ckt FROM m LEFT JOIN p USING (bus) WHERE m.bus IN (SELECT bus FROM q) AND (SELECT count(*) FROM m WHERE bus = (SELECT max(i) FROM e)) > 0)""")
def shortest_path(spark, sf_dir):
    """The shortest way from bus 1 to the last bus in service: each bus with the circuit that leads to it."""
    live = network.settle(network.in_service(spark.table("net_bus"), spark.table("net_element")))
    end = live.where("i <> j").agg(F.max("i")).first()[0]
    return outages.path(outages.forest(live, spark.createDataFrame([(1,)], "bus long")), end)


@query("SELECT (SELECT count(*) FROM net_bus) AS buses, (SELECT count(*) FROM net_bus WHERE ide = 4) AS isolated, count(*) AS elements, count(CASE WHEN st <> 1 THEN 1 END) AS out_of_service, count(CASE WHEN st = 1 AND (i IN (SELECT bus FROM net_bus WHERE ide = 4) OR j IN (SELECT bus FROM net_bus WHERE ide = 4)) THEN 1 END) AS at_isolated FROM net_element")
def network_build(spark, sf_dir):
    return outages.left_out(spark.table("net_bus"), spark.table("net_element"))


# edits


def _changes(spark):
    rows = spark.table("net_element").where("i % 4 = 0")
    first = rows.selectExpr("j AS i", "i AS j", "ckt", "1 AS seq", "map('st', '0') AS `values`")
    return first.union(rows.where("i % 8 = 0").selectExpr("i", "j", "ckt", "2 AS seq", "map('st', '1') AS `values`"))


@query("SELECT i, j, ckt, CAST(CASE WHEN i % 8 = 0 THEN 1 WHEN i % 4 = 0 THEN 0 ELSE st END AS INT) AS st FROM net_element")
def edit_set(spark, sf_dir):
    return edits.set_fields(spark.table("net_element"), _changes(spark), ["st"])


@query("SELECT i, j, ckt, 'st' AS field, CAST(st AS VARCHAR) AS was, CASE WHEN i % 8 = 0 THEN '1' ELSE '0' END AS now FROM net_element WHERE i % 4 = 0 AND st <> CASE WHEN i % 8 = 0 THEN 1 ELSE 0 END")
def edit_describe(spark, sf_dir):
    before = spark.table("net_element")
    return edits.describe(before, edits.set_fields(before, _changes(spark), ["st"]), ["i", "j", "ckt"], ["st"])


@query("SELECT i, j, ckt, CAST(st AS INT) AS st FROM net_element UNION ALL SELECT least(i, j), greatest(i, j), CASE WHEN EXISTS (SELECT 1 FROM net_element o WHERE least(o.i, o.j) = least(e.i, e.j) AND greatest(o.i, o.j) = greatest(e.i, e.j) AND o.ckt = '2') THEN '3' ELSE '2' END, 1 FROM net_element e WHERE i % 10 = 4 AND ckt = '1' AND j < i")
def edit_add(spark, sf_dir):
    return edits.add_circuits(spark.table("net_element"), spark.table("net_element").where("i % 10 = 4 AND ckt = '1' AND j < i"))


@query("SELECT n_name AS name, n_nationkey AS area FROM nation")
def area_by_name(spark, sf_dir):
    """Names in other letters; NATION_1 is the start of others too, and the equal one wins."""
    return edits.area_by_name(spark.table("nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("area_name")), spark.table("nation").select(F.col("n_name").alias("name")))


# library


@query("SELECT source, count(*) AS documents, count(CASE WHEN trim(text) = '' OR text IS NULL THEN 1 END) AS unreadable, count(DISTINCT md5(text)) AS contents FROM documents GROUP BY source")
def library_catalog(spark, sf_dir):
    d = spark.table("documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("unreadable"), F.count_distinct(F.md5("text")).alias("contents"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'new' WHEN doc_id % 13 = 5 AND doc_id % 2 = 1 THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE doc_id % 7 <> 2 UNION ALL SELECT doc_id, 'removed' FROM documents WHERE doc_id % 7 = 2 AND doc_id % 11 <> 3")
def library_refresh(spark, sf_dir):
    """Against the recorded files, sizes and hashes; contents are hashed only where the size or the time differs."""
    d = spark.table("documents").select(F.col("doc_id").alias("file"), "text", F.octet_length("text").alias("bytes"))
    recorded = d.where("file % 11 <> 3").select("file", "bytes", (F.col("file") % 13).alias("time"), F.sha2(F.expr("IF(file % 13 = 5 AND file % 2 = 1, concat(text, '.'), text)"), 256).alias("sha"))
    found = d.where("file % 7 <> 2").withColumn("time", F.when(F.col("file") % 13 == 5, 99).otherwise(F.col("file") % 13))
    return documents.refresh(found, recorded).select(F.col("file").alias("doc_id"), "state")


@query()
def passages(spark, sf_dir):
    """Without SQL, as each cut depends on the one before; tested on literals."""
    return documents.passages(spark.table("documents").select("doc_id", "text"), "doc_id", "text")


# streams


@query(_CONTINGENCY)
def stream_contingency_summary(spark, sf_dir):
    cols = ["event_idx", "contingency", *C.KEY, "viol", "loading_percent"]
    return streams.complete(spark, spark.table("cases").select(*cols), summaries.running_contingencies)


@query(_BRANCH.replace(_USABLE, "cases"))
def stream_branch_summary(spark, sf_dir):
    """All fields of the branch summary as a running result, over all cases."""
    cols = ["event_idx", "contingency", *C.KEY, "rate_mva", "viol", "loading_percent"]
    return streams.complete(spark, spark.table("cases").select(*cols), summaries.running_branches)


@query("SELECT run_id, CAST(least(total, done) AS BIGINT) AS done, total FROM (SELECT run_id, sum(CASE WHEN line LIKE 'contingency:%' THEN 10 ELSE 0 END) AS done, max(CASE WHEN line LIKE 'Total%' THEN CAST(regexp_extract(line, '([0-9]+)$', 1) AS BIGINT) END) AS total FROM solver_lines GROUP BY run_id) WHERE total IS NOT NULL")
def run_progress_chunks(spark, sf_dir):
    """A line of a chunk stands for ten contingencies here; what is done can't exceed the announced total."""
    chunk = F.when(F.col("line").startswith("contingency:"), 10).otherwise(0)
    total = F.regexp_extract("line", r"^Total.* (\d+)$", 1).try_cast("bigint")
    runs = spark.table("solver_lines").groupBy("run_id").agg(F.sum(chunk).alias("sum"), F.max(total).alias("total")).where("total IS NOT NULL")
    return runs.select("run_id", F.least("total", "sum").alias("done"), "total")
