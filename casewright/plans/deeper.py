"""Registered queries in more depth: keyed streaming state, star nodes, trees in logarithmic rounds, exact quantiles, chained lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import edits, master, network, objects, stars, summaries, tables
from casewright.plans.cases import _found
from casewright.plans.queries import _ABS, _CK, _CLASS, _DEC, _KEYS, query
from casewright.sources import raw, texttables
from casewright.streaming import progress

# solver progress

#: A third of the runs print a batch solver's lines.
_LINE = """CASE WHEN user_id % 3 = 0 THEN CASE event_type
   WHEN 'signup' THEN concat('[gpu-batch p0] classified ', event_id % 100 + 20, ' cases in 0.1 s: ', event_id % 50 + 10, ' GPU, ', event_id % 50 + 10, ' CPU')
   WHEN 'click' THEN concat('[gpu-batch p1] GPU chunk of ', event_id % 7 + 1, ' cases: done') WHEN 'purchase' THEN concat('[gpu-batch p0] paths: ', event_id % 90, ' reported from the GPU, 7 on the CPU path, none left')
   WHEN 'view' THEN 'Controller iteration = 1' ELSE 'Writing output files' END
  ELSE CASE event_type WHEN 'signup' THEN concat('Total contingencies to analyze: ', event_id % 100 + 1) WHEN 'click' THEN concat('  Contingency: ', event_id, ' success: true')
   WHEN 'view' THEN 'Controller iteration = 01' WHEN 'purchase' THEN 'power flow did not converge' ELSE 'post-processing' END END"""


@query("""SELECT * FROM (WITH e AS (SELECT user_id AS run_id, event_id AS n, CASE event_type WHEN 'click' THEN 'indexed' WHEN 'view' THEN 'controller' WHEN 'purchase' THEN 'solve' END AS kind, event_type AS t, user_id % 3 = 0 AS batch FROM events),
 g AS (SELECT *, max(CASE WHEN batch AND t = 'signup' THEN n END) OVER (PARTITION BY run_id) AS k FROM e),
 -- a batch run before its first classification counts controller marks; after the last one only its own lines count
 f AS (SELECT *, CASE WHEN batch THEN CASE WHEN kind = 'controller' THEN 'controller' END ELSE kind END AS mark, min(CASE WHEN batch AND t = 'signup' THEN n END) OVER (PARTITION BY run_id) AS first_k FROM g),
 o AS (SELECT run_id, arg_min(mark, n) FILTER (mark IS NOT NULL AND (first_k IS NULL OR n < first_k)) AS family FROM f GROUP BY run_id),
 w AS (SELECT f.*, o.family, max(CASE WHEN mark = family THEN n END) OVER u AS last_done FROM f JOIN o USING (run_id) WINDOW u AS (PARTITION BY f.run_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
 x AS (SELECT *, max(CASE WHEN t = 'error' AND last_done IS NOT NULL THEN n END) OVER (PARTITION BY run_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last_post FROM w),
 plain AS (SELECT run_id, any_value(family) AS family, CASE WHEN max(last_done) IS NULL THEN 'starting' WHEN max(last_post) > max(last_done) THEN 'postprocessing' ELSE 'solving' END AS phase, count(CASE WHEN mark = family THEN 1 END) AS completed,
  max(CASE WHEN t = 'signup' AND NOT coalesce(last_post > last_done, false) THEN n % 100 + 1 END) AS total, CASE WHEN any_value(family) = 'indexed' THEN max(last_done) END AS latest_index, CAST(NULL AS BIGINT) AS batch_cases, CAST(0 AS BIGINT) AS batch_solved FROM x WHERE k IS NULL GROUP BY run_id),
 mine AS (SELECT run_id, any_value(family) AS family, any_value(k) AS k, max(CASE WHEN t = 'purchase' AND n > k THEN n END) AS p, count(CASE WHEN t = 'error' AND n > k THEN 1 END) AS posts, sum(CASE WHEN t = 'click' AND n > k THEN n % 7 + 1 ELSE 0 END) AS solved FROM x WHERE k IS NOT NULL GROUP BY run_id)
 SELECT *, false AS silent FROM plain UNION ALL
 SELECT run_id, family, CASE WHEN p IS NOT NULL OR posts > 0 THEN 'postprocessing' ELSE 'solving' END, CASE WHEN p IS NULL THEN 0 ELSE greatest(k % 100 + 20, p % 90 + 7) END, k % 100 + 20, NULL, k % 50 + 10, CAST(least(k % 50 + 10, solved) AS BIGINT), false FROM mine)
""")
def stream_run_progress(spark, sf_dir):
    """Keyed state over a replayed stream of lines."""
    lines = spark.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), F.expr(_LINE).alias("line"))
    return progress.summary(spark, lines)


# the network of RAW cases, with star nodes

_LIVE = "(SELECT bus FROM net_bus WHERE ide <> 4)"
_ELEMENTS = f"""el AS (SELECT 'branch' AS kind, i AS bus, j AS "end", ckt, concat('Branch ', i, ' to ', j, ' circuit ', ckt) AS label, concat('BR_', i, '_', j, '_', ckt) AS outage FROM net_element WHERE st = 1 AND i IN {_LIVE} AND j IN {_LIVE}
 UNION ALL SELECT 'transformer', bus, bus + 1, '2', concat('Transformer ', bus, ' to ', bus + 1, ' circuit 2'), concat('BR_', bus, '_', bus + 1, '_2') FROM net_bus WHERE bus % 4 = 1 AND bus IN {_LIVE} AND bus + 1 IN {_LIVE}
 UNION ALL SELECT 'transformer winding', bus + w - 1, -star, '3', concat('Transformer ', bus, '-', bus + 1, '-', bus + 2, ' circuit 3, winding ', w), '' FROM (SELECT bus, row_number() OVER (ORDER BY bus) AS star FROM net_bus WHERE bus % 4 = 3), (SELECT unnest([1, 2]) AS w) WHERE bus + w - 1 IN {_LIVE})"""
_MOVES = f"""{_ELEMENTS}, mv AS (SELECT bus AS a, "end" AS b, label FROM el WHERE "end" >= 0 AND bus <> "end" UNION ALL SELECT "end", bus, label FROM el WHERE "end" >= 0 AND bus <> "end" UNION ALL SELECT x.bus, y.bus, y.label FROM el x JOIN el y ON x."end" = y."end" AND x."end" < 0 AND x.bus <> y.bus)"""


def _case_network(spark):
    return [network.settle(t) for t in raw.network_tables(_found(spark))]


@query(f"""SELECT * FROM (WITH {_ELEMENTS} SELECT kind, bus, "end", ckt, label, outage FROM el)""")
def network_elements(spark, sf_dir):
    """Elements in service of the RAW cases; three-winding transformers as windings to a star."""
    buses, branches, transformers, _ = _case_network(spark)
    return stars.elements(buses, branches, transformers)


def _hops(k: int) -> str:
    return f"""{_MOVES}, h(bus, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT mv.b, hops + 1 FROM h JOIN mv ON mv.a = h.bus WHERE hops < {k}), m AS (SELECT bus, min(hops) AS hops FROM h GROUP BY bus)"""


@query(f"""SELECT * FROM (WITH RECURSIVE {_hops(3)}
 SELECT m.bus, m.hops, (min(struct_pack(a := mv.a, l := mv.label))).a AS reached_from, (min(struct_pack(a := mv.a, l := mv.label))).l AS reached_by FROM m LEFT JOIN (mv JOIN m p ON p.bus = mv.a) ON mv.b = m.bus AND p.hops = m.hops - 1 GROUP BY m.bus, m.hops)""")
def k_hop_elements(spark, sf_dir):
    """Buses within three elements of bus 1, with the element that reaches each; a star costs nothing."""
    buses, branches, transformers, _ = _case_network(spark)
    return stars.reached(stars.moves(stars.elements(buses, branches, transformers)), [1], 3)


@query(f"""SELECT * FROM (WITH RECURSIVE {_hops(2)}, e AS (SELECT CASE WHEN "end" < 0 THEN CAST("end" AS VARCHAR) ELSE label END AS k, regexp_replace(label, ', winding .*', '') AS label, unnest(CASE WHEN "end" < 0 THEN [bus] ELSE [bus, "end"] END) AS bus FROM el)
 SELECT label, list_sort(list(DISTINCT e.bus)) AS buses, max(hops) AS hops FROM e LEFT JOIN m ON m.bus = e.bus GROUP BY k, label HAVING count(*) = count(hops))""")
def star_elements_near(spark, sf_dir):
    """Elements all of whose buses are within two elements of bus 1."""
    buses, branches, transformers, _ = _case_network(spark)
    found = network.settle(stars.elements(buses, branches, transformers))
    return stars.near(found, stars.reached(stars.moves(found), [1], 2))


@query(f"""SELECT * FROM (WITH RECURSIVE {_MOVES}, r(root, bus) AS (SELECT bus, bus FROM net_bus WHERE ide <> 4 UNION SELECT r.root, mv.b FROM r JOIN mv ON mv.a = r.bus), o AS (SELECT bus, min(root) AS root FROM r GROUP BY bus),
 b AS (SELECT o.root, o.bus, bus_name, ide, area, CASE WHEN o.bus % 2 = 0 THEN load_mw ELSE 0 END AS load_mw, generation_mw FROM o JOIN net_bus n ON n.bus = o.bus)
 SELECT row_number() OVER (ORDER BY count(*) DESC, root) AS island, count(*) AS bus_count, CAST(sum(CAST(load_mw AS DECIMAL(18,5))) AS DOUBLE) AS load_mw, CAST(sum(CAST(generation_mw AS DECIMAL(18,5))) AS DOUBLE) AS generation_mw, count(CASE WHEN ide = 3 THEN 1 END) > 0 AS has_swing_bus,
  list_transform(list_sort(list(DISTINCT area)), lambda x: concat(x, ' AREA ', x)) AS areas, list_transform(list_sort(list(struct_pack(b := bus, n := bus_name)))[1:10], lambda x: concat(x.b, ' ', trim(x.n))) AS first_buses FROM b GROUP BY root)""")
def island_facts(spark, sf_dir):
    """Islands, the largest first, with load, generation, swing bus, areas and first ten buses."""
    buses, branches, transformers, areas = _case_network(spark)
    return stars.islands(buses, stars.elements(buses, branches, transformers), areas)


# chained lookups, pages


def _chain(spark):
    customers = spark.table("customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("custkey"), F.col("c_name").alias("o_orderkey"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("_at"))
    customers = customers.union(customers.where("nation % 2 = 0").withColumn("_at", F.col("_at") + 10_000_000))
    nations = spark.table("nation").where("n_nationkey <> 3").select("n_nationkey", "n_name")
    return tables.lookups(spark.table("orders").select("o_orderkey", "o_custkey"), [
        tables.Lookup("customer", customers, "o_custkey", "custkey", ["o_orderkey", "nation"], ["_at"]), tables.Lookup("nation", nations, "nation", "n_nationkey", ["n_name"], ["n_nationkey"])])


@query("SELECT o_orderkey, o_custkey, c_name AS \"customer.o_orderkey\", c_nationkey AS nation, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 3")
def lookup_chain(spark, sf_dir):
    """Orders with their customer's name and nation, then the nation's name; a column that is there already gets the lookup's name in front."""
    return _chain(spark)[0]


@query("""SELECT 'customer' AS lookup, (SELECT count(*) FROM customer WHERE c_nationkey % 2 = 0) AS duplicates, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unmatched
 UNION ALL SELECT 'nation', 0, (SELECT count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IS NULL OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3))""")
def lookup_counts(spark, sf_dir):
    """Rows of each lookup passed over as duplicates and rows that found none, counted while the joined rows are written."""
    out, seen = _chain(spark)
    network.settle(out.withColumnRenamed("customer.o_orderkey", "name"))
    n = [o.get["n"] for o in seen]
    return spark.createDataFrame([("customer", n[0], n[1]), ("nation", n[2], n[3])], "lookup string, duplicates long, unmatched long")


@query("SELECT p_partkey, p_size_text, (SELECT count(*) FROM part) AS total, CAST(60 AS BIGINT) AS next_offset, true AS truncated FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS p_size_text FROM part) ORDER BY TRY_CAST(p_size_text AS DOUBLE) IS NULL, TRY_CAST(p_size_text AS DOUBLE), lower(p_size_text), p_partkey LIMIT 20 OFFSET 40")
def page_with_total(spark, sf_dir):
    """A page with the number of all rows and where the next one begins, in one job."""
    cells = spark.table("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("p_size_text"))
    return tables.page_with_total(cells, [*tables.mixed_order(F.col("p_size_text")), "p_partkey"], 40, 20)


@query(f"SELECT event_idx, {_KEYS}, loading_percent, {_ABS} AS value, (SELECT count(*) FROM cases WHERE event_idx % 2 = 1) AS total, CAST(10 AS BIGINT) AS next_offset, true AS truncated FROM cases WHERE event_idx % 2 = 1 ORDER BY value DESC, event_idx, {_KEYS}, loading_percent DESC LIMIT 10")
def topk_cases_total(spark, sf_dir):
    """The ten largest loadings of the cases that meet a condition, with the number of all that do."""
    value = F.abs("loading_percent")
    rows = spark.table("cases").where("event_idx % 2 = 1").select("event_idx", *C.KEY, "loading_percent", value.alias("value"))
    return tables.page_with_total(rows, [F.desc("value"), "event_idx", *C.KEY, F.desc("loading_percent")], 0, 10)


# objects: any group by any statistic, search

_NAMED = {"facility": ["control_area", "tie", "voltage_class", "nominal_kv", "branch_type", "binding_contingency"], "contingency": ["type", "status_code", "converged", "outage_area"], "case": ["contingency", "facility"]}
_OBJECTS = f"""fac AS (SELECT f.*, a.area_name AS fa, b.area_name AS ta, greatest(x.base_kv, y.base_kv) AS kv, raw_branch_type, CASE WHEN rate > 0 THEN value END AS v FROM (SELECT {_KEYS}, max({_ABS}) AS value, max(rate_mva) AS rate, (min(struct_pack(a := -{_ABS}, e := event_idx, c := contingency))).c AS bind FROM cases GROUP BY ALL) f
  LEFT JOIN buses x ON x.bus_id = from_bus LEFT JOIN areas a ON a.area = x.area LEFT JOIN buses y ON y.bus_id = to_bus LEFT JOIN areas b ON b.area = y.area LEFT JOIN branch_metadata m USING ({_KEYS})),
 con AS (SELECT c.contingency, max({_ABS}) AS v, any_value(r.type) AS type, any_value(r.status_code) AS status_code, any_value(r.converged) AS converged FROM cases c LEFT JOIN convergence r USING (event_idx, contingency) WHERE event_idx <> 0 GROUP BY c.event_idx, c.contingency),
 cb AS (SELECT contingency, type, status_code, converged, v, [a.area_name, b.area_name] AS areas FROM (SELECT *, regexp_extract_all(contingency, '[0-9]+') AS n FROM con) LEFT JOIN buses x ON x.bus_id = TRY_CAST(n[1] AS INT) LEFT JOIN areas a ON a.area = x.area LEFT JOIN buses y ON y.bus_id = CASE WHEN contingency LIKE 'BR%' THEN TRY_CAST(n[2] AS INT) END LEFT JOIN areas b ON b.area = y.area),
 ob AS (SELECT 'facility' AS family, 'control_area' AS "group", unnest(list_distinct([fa, ta])) AS label, v FROM fac UNION ALL SELECT 'facility', 'tie', CASE WHEN fa <> ta THEN 'true' ELSE 'false' END, v FROM fac
  UNION ALL SELECT 'facility', 'voltage_class', {_CLASS.format('kv')}, v FROM fac UNION ALL SELECT 'facility', 'nominal_kv', CAST(kv AS VARCHAR), v FROM fac UNION ALL SELECT 'facility', 'branch_type', raw_branch_type, v FROM fac UNION ALL SELECT 'facility', 'binding_contingency', bind, v FROM fac
  UNION ALL SELECT 'contingency', 'type', type, v FROM cb UNION ALL SELECT 'contingency', 'status_code', status_code, v FROM cb UNION ALL SELECT 'contingency', 'converged', converged, v FROM cb UNION ALL SELECT 'contingency', 'outage_area', unnest(list_distinct(list_filter(areas, lambda x: x IS NOT NULL))), v FROM cb
  UNION ALL SELECT 'case', 'contingency', contingency, {_ABS} FROM cases UNION ALL SELECT 'case', 'facility', {_CK}, {_ABS} FROM cases)"""


def _objects(spark):
    """Every family's groups and values."""
    b = spark.table("buses").join(spark.table("areas"), "area", "left").select("bus_id", "area_name", "base_kv")
    # each family is read several times, and all stand on the cases
    cases, size = network.settle(spark.table("cases").select("event_idx", "contingency", *C.KEY, "rate_mva", "loading_percent")), F.abs("loading_percent")
    # extremes by hash aggregation, then only the cases that reach them
    peak = cases.groupBy(*C.KEY).agg(F.max(size).alias("top"), F.max("rate_mva").alias("rate"))
    same = " AND ".join(f"c.{k} <=> p.{k}" for k in C.KEY)
    reach = cases.alias("c").join(peak.alias("p"), F.expr(f"{same} AND abs(c.loading_percent) <=> p.top"))
    fac = reach.groupBy(*(F.col(f"p.{k}") for k in C.KEY), "top", "rate").agg(F.min(F.struct("event_idx", "contingency")).alias("at"))
    fac = fac.select(*C.KEY, F.expr("CASE WHEN rate > 0 THEN top END").alias("v"), F.col("at.contingency").alias("bind"))
    fac = fac.join(b.toDF("from_bus", "fa", "fk"), "from_bus", "left").join(b.toDF("to_bus", "ta", "tk"), "to_bus", "left").join(spark.table("branch_metadata").drop("rate_mva"), list(C.KEY), "left")
    kv, areas = F.greatest("fk", "tk"), F.array("fa", "ta")
    fac = network.settle(fac)
    yield "facility", fac, dict(zip(_NAMED["facility"], [objects.ends(areas), objects.label(C.tie_flag(areas)), objects.label(C.voltage_class(kv)), objects.label(kv), objects.label(F.col("raw_branch_type")), objects.label(F.col("bind"))])), F.col("v")
    con = network.settle(cases.where("event_idx <> 0").groupBy("event_idx", "contingency").agg(F.max(size).alias("v")).join(spark.table("convergence"), ["event_idx", "contingency"], "left"))
    at = con.select("event_idx", "contingency", F.explode(C.outage_buses(F.col("contingency"))).alias("bus_id")).join(b, "bus_id").groupBy("event_idx", "contingency").agg(F.collect_set("area_name").alias("areas"))
    con = network.settle(con.join(at, ["event_idx", "contingency"], "left"))
    yield "contingency", con, dict(zip(_NAMED["contingency"], [*(objects.label(F.col(c)) for c in ("type", "status_code", "converged")), objects.ends(F.coalesce("areas", F.array().cast("array<string>")))])), F.col("v")
    yield "case", cases, {"contingency": objects.label(F.col("contingency")), "facility": objects.label(C.case_key())}, size


@query(f"""SELECT * FROM (WITH {_OBJECTS} SELECT *, row_number() OVER (PARTITION BY family, "group" ORDER BY mean DESC NULLS LAST, label) AS rank FROM (
 SELECT family, "group", label, count(*) AS objects, count(v) AS used, {_DEC.format('v')} AS total, {_DEC.format('v')} / count(v) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high, round(stddev_pop(v), 6) AS sd, round(var_pop(v), 4) AS variance, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT family, "group", coalesce(label, 'unknown') AS label, v FROM ob) GROUP BY ALL))""")
def rank_groups_any(spark, sf_dir):
    """Facilities, contingencies and cases by each of their groups with all nine statistics, ranked by mean."""
    parts = [objects.grouped(rows, groups, value).select(F.lit(family).alias("family"), "*") for family, rows, groups, value in _objects(spark)]
    return objects.ranked(network.settle(parts[0].union(parts[1]).union(parts[2])), "mean", ["family", "group"])


@query("""SELECT kind, record FROM (SELECT 'load' AS kind, concat(bus, ' 1') AS record, [CAST(bus AS VARCHAR), '1'] AS k, [bus] AS b FROM net_bus WHERE bus % 2 = 0 UNION ALL SELECT 'generator', concat(bus, ' 1'), [CAST(bus AS VARCHAR), '1'], [bus] FROM net_bus WHERE generation_mw <> 0
  UNION ALL SELECT 'branch', concat(i, ' ', j, ' ', ckt), [CAST(i AS VARCHAR), CAST(j AS VARCHAR), ckt], [i, j] FROM net_element UNION ALL SELECT 'transformer', concat_ws(' ', bus, bus + 1, 0, 2), [CAST(bus AS VARCHAR), CAST(bus + 1 AS VARCHAR), '2'], [bus, bus + 1] FROM net_bus WHERE bus % 4 = 1
  UNION ALL SELECT 'transformer', concat_ws(' ', bus, bus + 1, bus + 2, 3), [CAST(bus AS VARCHAR), CAST(bus + 1 AS VARCHAR), CAST(bus + 2 AS VARCHAR), '3'], [bus, bus + 1, bus + 2] FROM net_bus WHERE bus % 4 = 3) r
 WHERE (list_contains(k, '1') OR EXISTS (SELECT 1 FROM net_bus n WHERE list_contains(b, n.bus) AND contains(lower(n.bus_name), '1'))) AND (list_contains(k, '7') OR EXISTS (SELECT 1 FROM net_bus n WHERE list_contains(b, n.bus) AND contains(lower(n.bus_name), '7')))""")
def search_all_records(spark, sf_dir):
    """Loads, generators, branches and transformers of the RAW cases that meet "7 1"."""
    found = network.settle(_found(spark))
    return objects.search(raw.searchable(found), raw.network_tables(found)[0].select("bus", "bus_name"), "7 1")


# master of six tables

_SIX = {"pflow": ("0", "avg", "p_from_mw"), "pflow_mm": ("1", "max", "p_from_mw"), "qflow": ("2", "avg", "v_from_pu"), "qflow_mm": ("3", "max", "v_from_pu"), "perf_mm": ("4", "max", "loading_percent"), "line_flt_cnt": ("5", "count", "viol")}
_SIX_SQL = {n: f"(SELECT {_KEYS}, {'min' if f == 'avg' else f}({v}) AS value, CASE WHEN min(from_bus) % 2 = {k} % 2 THEN concat('area ', min(from_bus)) ELSE ' ' END AS area FROM cases WHERE event_idx % 6 = {k} GROUP BY ALL)" for n, (k, f, v) in _SIX.items()}
_AREAS = ["perf_mm_area", "pflow_area", "pflow_mm_area", "line_flt_cnt_area"]
_MASTER_SIX = f"""(SELECT {_KEYS}, d.rate_mva, d.raw_branch_type, {', '.join(f'{n}.value AS {n}_value, {n}.area AS {n}_area' for n in _SIX)}, coalesce({', '.join(f"nullif(trim({a[:-5]}.area), '')" for a in _AREAS)}) AS area
 FROM (SELECT * FROM branch_metadata WHERE line_id <> '2') d {' '.join(f'FULL JOIN {q} {n} USING ({_KEYS})' for n, q in _SIX_SQL.items())})"""


def _master_six(spark, buckets=8):
    side = lambda k, f, v: spark.table("cases").where(f"event_idx % 6 = {k}").groupBy(*C.KEY).agg(F.expr(f"{'min' if f == 'avg' else f}({v})").alias("value"), F.expr(f"CASE WHEN min(from_bus) % 2 = {k} % 2 THEN concat('area ', min(from_bus)) ELSE ' ' END").alias("area"))
    sides = {"base": spark.table("branch_metadata").where("line_id <> '2'")} | {n: side(*x) for n, x in _SIX.items()}
    return master.assembled(spark, master.bucketed(spark, sides, buckets), buckets, {"area": _AREAS})


@query(f"SELECT * FROM {_MASTER_SIX}")
def branch_master_six(spark, sf_dir):
    """The base and six result tables on the facility key, from bucketed tables; the area comes from the first of four tables that has one."""
    return _master_six(spark)


@query(f"""SELECT {_KEYS}, area, part, concat_ws('; ', CASE WHEN abs(pflow_mm_value) > 20 THEN 'flow' END, CASE WHEN abs(perf_mm_value) > 90 THEN 'loading' END) AS outlier_reason FROM {_MASTER_SIX}, (SELECT unnest(['master', 'cleaned', 'outliers']) AS part)
 WHERE part = 'master' OR (part = 'outliers') = (coalesce(abs(pflow_mm_value) > 20, false) OR coalesce(abs(perf_mm_value) > 90, false))""")
def master_exports(spark, sf_dir):
    """Master, cleaned rows and outliers, written in one pass and read back."""
    rows, path = _master_six(spark).select(*C.KEY, "area", "pflow_mm_value", "perf_mm_value"), network.shared_path(spark, "export")
    master.write_exports(rows, F.concat_ws("; ", F.when(F.abs("pflow_mm_value") > 20, "flow"), F.when(F.abs("perf_mm_value") > 90, "loading")), path)
    read = lambda part: master.read_export(spark, path, rows.schema, part).select(*C.KEY, "area", F.lit(part).alias("part"), F.coalesce("outlier_reason", F.lit("")).alias("outlier_reason")).withColumn("section", F.coalesce("section", F.lit("")))
    return read("master").union(read("cleaned")).union(read("outliers"))


# text tables


def _text_files(spark) -> str:
    top = network.shared_path(spark, "tables")
    s = spark.table("supplier")
    put = lambda name, line: s.select(F.expr(line).alias("value")).write.text(f"{top}/{name}.txt")
    put("vmag_mm", "concat_ws('  ', '', s_suppkey, s_nationkey, 1.0, 0.9, IF(s_suppkey % 7 = 2, 'high', '1.1'), 0.1, 0.1, 3, IF(s_suppkey % 11 = 5, '4.5', '4'))")
    put("pgen", "concat_ws(' ', s_suppkey, s_nationkey, '1', s_acctbal, 0.5, 1e-3, IF(s_suppkey % 5 = 1, 'extra', NULL))")
    put("perf_sum", "IF(s_suppkey % 3 = 0, '   ', concat_ws('\t', s_suppkey, s_acctbal, '-1.5E2'))")
    put("line_flt_cnt", "concat_ws(' ', s_suppkey, s_nationkey, s_nationkey + 1, 'A', IF(s_suppkey % 13 = 4, 'x', string(s_suppkey % 4)))")
    put("notes", "'not a table'")
    return top


@query("""SELECT 'vmag_mm' AS name, count(CASE WHEN s_suppkey % 7 <> 2 AND s_suppkey % 11 <> 5 THEN 1 END) AS accepted, 0 AS wrong_width, count(CASE WHEN s_suppkey % 7 = 2 OR s_suppkey % 11 = 5 THEN 1 END) AS unreadable FROM supplier
 UNION ALL SELECT 'pgen', count(CASE WHEN s_suppkey % 5 <> 1 THEN 1 END), count(CASE WHEN s_suppkey % 5 = 1 THEN 1 END), 0 FROM supplier UNION ALL SELECT 'perf_sum', count(*), 0, 0 FROM supplier WHERE s_suppkey % 3 <> 0
 UNION ALL SELECT 'line_flt_cnt', count(CASE WHEN s_suppkey % 13 <> 4 THEN 1 END), 0, count(CASE WHEN s_suppkey % 13 = 4 THEN 1 END) FROM supplier""")
def text_table_rejects(spark, sf_dir):
    """Accepted and rejected lines of four tables' files, read together and told apart by their names."""
    return texttables.rejects(texttables.lines(spark, _text_files(spark)))


@query("SELECT s_suppkey AS row_index, CAST(s_nationkey AS BIGINT) AS bus_id, CAST(1 AS DOUBLE) AS base_value, CAST(0.9 AS DOUBLE) AS min_value, CAST(1.1 AS DOUBLE) AS max_value, CAST(0.1 AS DOUBLE) AS min_deviation, CAST(0.1 AS DOUBLE) AS max_deviation, CAST(3 AS BIGINT) AS min_contingency, CAST(4 AS BIGINT) AS max_contingency FROM supplier WHERE s_suppkey % 7 <> 2 AND s_suppkey % 11 <> 5")
def text_table_rows(spark, sf_dir):
    return texttables.table(texttables.lines(spark, _text_files(spark)), "vmag_mm")


# totals and worst lists


@query("""SELECT violation, count(*) AS total, count(CASE WHEN success THEN 1 END) AS success, count(CASE WHEN NOT success THEN 1 END) AS failure, count(*) - count(success) AS unknown, round(count(CASE WHEN success THEN 1 END) * 100 / count(*), 4) AS success_rate_pct,
 round(count(CASE WHEN NOT success THEN 1 END) * 100 / count(*), 4) AS failure_rate_pct, count(CASE WHEN isolated THEN 1 END) AS isolated
 FROM (SELECT CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 2 = 0 END AS success, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE ['voltage', 'flow'][CAST(event_id % 2 AS INT) + 1] END AS violation, event_id % 7 = 0 AS isolated FROM events) GROUP BY GROUPING SETS ((violation), ())""")
def success_totals(spark, sf_dir):
    """Totals and rates of a success log, overall and by violation."""
    log = spark.table("events").select(F.expr("CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 2 = 0 END").alias("success"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'voltage' ELSE 'flow' END").alias("violation"), F.expr("event_id % 7 = 0").alias("isolated"))
    return summaries.success_totals(log)


_VOLTS = "(SELECT bus, min(v) AS low, max(v) AS high FROM (SELECT from_bus AS bus, v_from_pu AS v FROM cases UNION ALL SELECT to_bus, v_to_pu FROM cases) WHERE v IS NOT NULL GROUP BY bus)"


@query(f"""SELECT * FROM (SELECT 'low' AS side, CAST(row_number() OVER (ORDER BY low, bus) AS INT) AS rank, bus, low AS value, count(*) OVER () AS buses, count(CASE WHEN low < 0.95 THEN 1 END) OVER () AS beyond FROM {_VOLTS}
 UNION ALL SELECT 'high', CAST(row_number() OVER (ORDER BY high DESC, bus) AS INT), bus, high, count(*) OVER (), count(CASE WHEN high > 1.02 THEN 1 END) OVER () FROM {_VOLTS}) WHERE rank <= 10""")
def voltage_extremes(spark, sf_dir):
    """The ten buses with the lowest and the ten with the highest voltages, and how many lie beyond the limits."""
    return summaries.voltage_extremes(spark.table("cases"), 0.95, 1.02)


_FLOW = "(SELECT event_idx, CAST(sum(CAST(CASE WHEN f.area = 0 THEN p_from_mw ELSE -p_from_mw END AS DECIMAL(18,6))) AS DOUBLE) AS flow_mw FROM cases JOIN buses f ON f.bus_id = from_bus JOIN buses t ON t.bus_id = to_bus WHERE (f.area = 0 AND t.area = 1) OR (f.area = 1 AND t.area = 0) GROUP BY event_idx)"


@query(f"SELECT max(CASE WHEN event_idx = 0 THEN flow_mw END) AS base_mw, min(flow_mw) AS min_mw, (min(struct_pack(v := flow_mw, e := event_idx))).e AS min_event, max(flow_mw) AS max_mw, (min(struct_pack(v := -flow_mw, e := event_idx))).e AS max_event, count(*) AS events FROM {_FLOW}")
def interface_extremes(spark, sf_dir):
    """Base, smallest and largest flow between two areas, with their events."""
    return summaries.flow_extremes(summaries.interface_flow(spark.table("cases"), spark.table("buses"), 0, 1))


@query("""SELECT area, CAST(sum(CAST(load_mw AS DECIMAL(18,5))) AS DOUBLE) AS load_before, CAST(sum(CAST(l AS DECIMAL(18,5))) AS DOUBLE) AS load_after, CAST(sum(CAST(generation_mw AS DECIMAL(18,5))) AS DOUBLE) AS generation_before, CAST(sum(CAST(generation_mw AS DECIMAL(18,5))) AS DOUBLE) AS generation_after,
 CAST(sum(CAST(load_mw AS DECIMAL(18,5))) - sum(CAST(l AS DECIMAL(18,5))) AS DOUBLE) AS imbalance_mw, coalesce(list_sort(list(bus) FILTER (ide = 3)), []) AS carried_by
 FROM (SELECT *, CASE WHEN area = 3 THEN load_mw * 1.5 ELSE load_mw END AS l FROM net_bus WHERE ide <> 4) GROUP BY GROUPING SETS ((area), ())""")
def edit_imbalance(spark, sf_dir):
    """Totals before and after a scaling, what it leaves unbalanced, and the swing buses that carry it."""
    before = spark.table("net_bus").withColumn("bus", F.col("bus").cast("long"))
    return edits.totals(before, edits.scaled(before, 3, "load_mw", factor=1.5))
