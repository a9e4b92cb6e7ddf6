"""More registered queries: metrics, groups, table reads, edits, ranks, retrieval and files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import columns as C
from casewright.operators import network, quantiles, ranking, retrieval, summaries, tables
from casewright.plans.queries import _ABS, _DEC, _FAC, _KEYS, _stats, query
from casewright.sources import files


def _sum(c):
    return F.sum(c.cast("decimal(18,5)")).cast("double")


@query(f"SELECT count(*) AS n, {_DEC.format('value')} / count(*) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS high, count(CASE WHEN value > 80 THEN 1 END) AS over_80, count(CASE WHEN value > 100 THEN 1 END) AS over_100 FROM ({_FAC})")
def thermal_metrics(spark, sf_dir):
    counts = quantiles.counted(_facilities(spark), [], F.col("value"))
    median = quantiles.select(counts, [], (0.5,)).select(F.col("q")[0].alias("median"))
    over = lambda x: F.coalesce(F.sum(F.when(F.col("_v") > x, F.col("_c"))), F.lit(0))
    total = F.sum(F.col("_v").cast("decimal(18,5)") * F.col("_c").cast("decimal(18,0)")).cast("double")
    sums = counts.agg(F.sum("_c").alias("n"), (total / F.sum("_c")).alias("mean"), F.max("_v").alias("high"), over(80).alias("over_80"), over(100).alias("over_100"))
    return sums.join(F.broadcast(median)).select("n", "mean", "median", "high", "over_80", "over_100")


def _facilities(spark):
    return spark.table("cases").groupBy(*C.KEY).agg(F.max(F.abs("loading_percent")).alias("value"), F.max("rate_mva").alias("rate"))


@query(f"SELECT {_KEYS}, value FROM ({_FAC}) ORDER BY value DESC, {_KEYS} LIMIT 25")
def thermal_bottlenecks(spark, sf_dir):
    return _facilities(spark).select(*C.KEY, "value").orderBy(F.desc("value"), *C.KEY).limit(25)


@query(f"SELECT {_KEYS}, value, row_number() OVER (ORDER BY value, {_KEYS}) AS position FROM ({_FAC}) WHERE rate > 0")
def utilization_curve(spark, sf_dir):
    rated = _facilities(spark).where("rate > 0").select(*C.KEY, "value")
    return ranking.numbered(rated, ["value", *C.KEY], "position")


@query("SELECT count(CASE WHEN v_from_pu < 0.95 OR v_to_pu < 0.95 THEN 1 END) AS low_cases, count(CASE WHEN v_from_pu > 1.02 OR v_to_pu > 1.02 THEN 1 END) AS high_cases, min(least(v_from_pu, v_to_pu)) AS lowest, max(greatest(v_from_pu, v_to_pu)) AS highest FROM cases")
def voltage_metrics(spark, sf_dir):
    return spark.table("cases").agg(F.count_if(F.expr("v_from_pu < 0.95 OR v_to_pu < 0.95")).alias("low_cases"), F.count_if(F.expr("v_from_pu > 1.02 OR v_to_pu > 1.02")).alias("high_cases"),
        F.min(F.least("v_from_pu", "v_to_pu")).alias("lowest"), F.max(F.greatest("v_from_pu", "v_to_pu")).alias("highest"))


@query("SELECT contingency, count(CASE WHEN viol = 1 THEN 1 END) AS violations FROM cases GROUP BY contingency HAVING violations > 0 ORDER BY violations DESC, contingency LIMIT 20")
def ranked_counts(spark, sf_dir):
    return spark.table("cases").groupBy("contingency").agg(F.count_if(F.col("viol") == 1).alias("violations")).where("violations > 0").orderBy(F.desc("violations"), "contingency").limit(20)


_RATED = f"(SELECT a.area AS fa, b.area AS ta, greatest(a.base_kv, b.base_kv) AS kv, value FROM ({_FAC}) f JOIN buses a ON a.bus_id = from_bus JOIN buses b ON b.bus_id = to_bus WHERE rate > 0 AND greatest(a.base_kv, b.base_kv) >= 50)"


def _rated(spark):
    b = spark.table("buses").select("bus_id", "area", "base_kv")
    ends = _facilities(spark).where("rate > 0").join(b.toDF("from_bus", "fa", "f_kv"), "from_bus").join(b.toDF("to_bus", "ta", "t_kv"), "to_bus")
    return ends.withColumn("kv", F.greatest("f_kv", "t_kv")).where("kv >= 50")


@query(f"SELECT area, count(*) AS n, {_DEC.format('value')} / count(*) AS mean FROM (SELECT fa AS area, value FROM {_RATED} UNION ALL SELECT ta, value FROM {_RATED} WHERE fa <> ta) GROUP BY area")
def control_area_utilization(spark, sf_dir):
    tied = _rated(spark).withColumn("area", F.explode(F.array_distinct(F.array("fa", "ta"))))
    return tied.groupBy("area").agg(F.count("*").alias("n"), (_sum(F.col("value")) / F.count("*")).alias("mean"))


_BANDED = "CASE " + " ".join(f"WHEN kv < {edge} THEN '{name}'" for edge, name in C.VOLTAGE_BANDS) + f" ELSE '{C.TOP_BAND}' END"


@query(f"SELECT {_BANDED} AS voltage_class, count(*) AS n, {_DEC.format('value')} / count(*) AS mean, max(value) AS high FROM {_RATED} GROUP BY 1")
def voltage_group_utilization(spark, sf_dir):
    return _rated(spark).groupBy(C.voltage_class(F.col("kv")).alias("voltage_class")).agg(F.count("*").alias("n"), (_sum(F.col("value")) / F.count("*")).alias("mean"), F.max("value").alias("high"))


@query(f"SELECT label, mean, row_number() OVER (ORDER BY mean DESC, label) AS rank FROM (SELECT a.area_name AS label, {_DEC.format('loading_percent')} / count(*) AS mean FROM cases JOIN buses b ON b.bus_id = from_bus JOIN areas a ON a.area = b.area GROUP BY 1)")
def rank_groups_area(spark, sf_dir):
    named = spark.table("cases").join(spark.table("buses").join(spark.table("areas"), "area"), F.col("from_bus") == F.col("bus_id"))
    means = named.groupBy(F.col("area_name").alias("label")).agg((_sum(F.col("loading_percent")) / F.count("*")).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "label")).cast("long"))


@query(f"SELECT DISTINCT event_idx, {_KEYS}, loading_percent FROM cases WHERE event_idx IN (SELECT event_idx FROM convergence WHERE status_code = 'ISLANDED')")
def case_semi_join(spark, sf_dir):
    events = spark.table("convergence").where("status_code = 'ISLANDED'").select("event_idx").distinct()
    return spark.table("cases").join(events, "event_idx", "left_semi").select("event_idx", *C.KEY, "loading_percent").distinct()


@query(f"SELECT c.event_idx, {_KEYS}, loading_percent, v.status_code, v.iterations, b.bus_name FROM cases c LEFT JOIN convergence v ON v.event_idx = c.event_idx AND v.contingency = c.contingency LEFT JOIN buses b ON b.bus_id = c.from_bus WHERE loading_percent >= 95")
def case_records(spark, sf_dir):
    v = spark.table("convergence").select("event_idx", "contingency", "status_code", "iterations")
    b = spark.table("buses").select(F.col("bus_id").alias("from_bus"), "bus_name")
    return spark.table("cases").where("loading_percent >= 95").join(v, ["event_idx", "contingency"], "left").join(b, "from_bus", "left").select("event_idx", *C.KEY, "loading_percent", "status_code", "iterations", "bus_name")


@query("SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 40".replace("l_quantity AS v", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS label").replace("n DESC, v", "n DESC, label"))
def top_categories(spark, sf_dir):
    return tables.top_categories(spark.table("lineitem").select(F.col("l_quantity").cast("bigint").cast("string").alias("q")), "q", 40)


@query("SELECT bin, count(*) AS n, min(v) AS low, max(v) AS high FROM (SELECT v, CAST(least(10, floor((v - lo) / (hi - lo) * 10) + 1) AS BIGINT) AS bin FROM (SELECT l_quantity AS v FROM lineitem), (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) GROUP BY bin")
def equal_width_bins(spark, sf_dir):
    return tables.equal_width_bins(spark.table("lineitem").select(F.col("l_quantity").alias("v")), "v", 10)


@query("SELECT round(CAST(sum(CASE WHEN r <= ceil(n * 0.1) THEN v ELSE 0 END) / sum(v) AS DOUBLE), 6) AS share FROM (SELECT CAST(o_totalprice AS DECIMAL(18,5)) AS v, row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,5)) DESC) AS r, count(*) OVER () AS n FROM orders WHERE o_totalprice >= 0)")
def top_share(spark, sf_dir):
    return tables.top_share(spark.table("orders"), "o_totalprice", 0.1)


@query("SELECT coalesce(nullif(trim(o_orderstatus), ''), '(blank)') AS label, count(*) AS n_rows, count(x) AS n_numeric, count(*) - count(x) AS n_skipped, min(x) AS low, max(x) AS high FROM (SELECT o_orderstatus, TRY_CAST(o_orderpriority AS DOUBLE) AS x FROM orders) GROUP BY 1")
def group_any(spark, sf_dir):
    return tables.group_any(spark.table("orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT value FROM (VALUES ('BUILDING'), ('SHIPYARD'), ('x')) t(value) WHERE value NOT IN (SELECT c_mktsegment FROM customer)")
def missing_values(spark, sf_dir):
    return tables.missing_values(spark.table("customer"), "c_mktsegment", ["BUILDING", "SHIPYARD", "x"])


@query("SELECT from_bus, contingency AS first_contingency, event_idx AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY from_bus ORDER BY event_idx, contingency) AS r FROM cases) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    one = tables.first_per_key(spark.table("cases").select("from_bus", F.col("event_idx").alias("first_event"), F.col("contingency").alias("first_contingency")), ["from_bus"], ["first_event", "first_contingency"])
    return one.select("from_bus", "first_contingency", "first_event")


@query("SELECT c_custkey, c_nationkey, o_orderkey, coalesce(n, 0) AS o_matches FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    orders = spark.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("orderkey"))
    return tables.lookup(spark.table("customer").select("c_custkey", "c_nationkey"), orders, "c_custkey", ["orderkey"], "o_")


_SIDE = "(SELECT from_bus, to_bus, line_id, section, max(rate_mva) AS r, max(loading_percent) AS v FROM {0} GROUP BY ALL)"


@query(f"SELECT {_KEYS}, a.r AS before, b.r AS after, CASE WHEN a.v IS NULL THEN 'only after' WHEN b.v IS NULL THEN 'only before' ELSE 'changed' END AS kind FROM {_SIDE.format('cases')} a FULL JOIN {_SIDE.format('cases_b')} b USING ({_KEYS}) WHERE a.v IS NULL OR b.v IS NULL OR a.r IS DISTINCT FROM b.r")
def document_diff(spark, sf_dir):
    side = lambda t: spark.table(t).groupBy(*C.KEY).agg(F.max("rate_mva").alias("r"))
    return tables.difference(side("cases"), side("cases_b"), list(C.KEY), "r")


@query(f"SELECT count(CASE WHEN b.v IS NULL THEN 1 END) AS missing, count(CASE WHEN a.v IS NULL THEN 1 END) AS extra, count(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND a.r <> b.r THEN 1 END) AS r_differing, max(abs(a.r - b.r)) AS r_largest FROM {_SIDE.format('cases')} a FULL JOIN {_SIDE.format('cases_b')} b USING ({_KEYS})")
def result_agreement(spark, sf_dir):
    side = lambda t: spark.table(t).groupBy(*C.KEY).agg(F.max("rate_mva").alias("r"))
    return tables.agreement(side("cases"), side("cases_b"), list(C.KEY), ["r"])


@query("SELECT p_partkey, p_size_text FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS p_size_text FROM part) ORDER BY TRY_CAST(p_size_text AS DOUBLE) IS NULL, TRY_CAST(p_size_text AS DOUBLE), lower(p_size_text), p_partkey LIMIT 20 OFFSET 40")
def mixed_sort_page(spark, sf_dir):
    cells = spark.table("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("p_size_text"))
    return tables.page(cells, [*tables.mixed_order(F.col("p_size_text")), "p_partkey"], 40, 20)


@query("SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry(spark, sf_dir):
    marked = tables.carry(spark.table("events"), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "section")
    return marked.select("event_id", "user_id", "section")


@query("SELECT 'unknown bus' AS finding, i, j, ckt FROM net_element WHERE i NOT IN (SELECT bus FROM net_bus) OR j NOT IN (SELECT bus FROM net_bus) UNION ALL SELECT 'same bus', i, j, ckt FROM net_element WHERE i = j UNION ALL SELECT 'duplicate key', least(i, j), greatest(i, j), ckt FROM net_element GROUP BY 2, 3, 4 HAVING count(*) > 1 UNION ALL SELECT 'isolated end', i, j, ckt FROM net_element WHERE st = 1 AND (i IN (SELECT bus FROM net_bus WHERE ide = 4) OR j IN (SELECT bus FROM net_bus WHERE ide = 4))")
def edit_checks(spark, sf_dir):
    return network.findings(spark.table("net_bus"), spark.table("net_element"))


@query("SELECT area, " + _DEC.format("load_mw") + " AS load_before, " + _DEC.format("CASE WHEN area = 3 AND ide <> 4 THEN load_mw * 1.5 ELSE load_mw END") + " AS load_after FROM net_bus GROUP BY GROUPING SETS ((area), ())")
def edit_totals(spark, sf_dir):
    after = F.when((F.col("area") == 3) & (F.col("ide") != 4), F.col("load_mw") * 1.5).otherwise(F.col("load_mw"))
    return spark.table("net_bus").groupingSets([["area"], []], "area").agg(_sum(F.col("load_mw")).alias("load_before"), _sum(after).alias("load_after"))


@query("SELECT status_code, count(*) AS n, min(event_idx) AS first_event FROM convergence GROUP BY status_code")
def outage_status(spark, sf_dir):
    return spark.table("convergence").groupBy("status_code").agg(F.count("*").alias("n"), F.min("event_idx").alias("first_event"))


@query(f"SELECT contingency, unnest(list_transform(regexp_extract_all(contingency, '[0-9]+'), lambda x: CAST(x AS INT))[1:CASE WHEN contingency LIKE 'BR%' THEN 2 ELSE 1 END]) AS bus FROM (SELECT DISTINCT contingency FROM cases WHERE contingency <> 'base_case')")
def outage_buses(spark, sf_dir):
    return spark.table("cases").select("contingency").distinct().select("contingency", F.explode(C.outage_buses(F.col("contingency"))).alias("bus"))


@query(f"SELECT raw_branch_type AS label, {_stats('rate_mva')} FROM branch_metadata GROUP BY 1")
def group_facilities_type(spark, sf_dir):
    return summaries.by_group(spark.table("branch_metadata"), "raw_branch_type", F.col("rate_mva"))


@query("SELECT v.vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings v")
def vector_norms(spark, sf_dir):
    return spark.table("embeddings").select("vec_id", F.round(F.sqrt(F.expr("aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))")), 6).alias("norm"))


@query(f"SELECT event_idx, from_bus, to_bus, line_id, loading_percent, rate_mva FROM cases")
def scan_cases_typed(spark, sf_dir):
    """Cases written as CSV with other header names, and read back through the aliases."""
    path = network.shared_path(spark, "csv")
    spark.table("cases").selectExpr("event_idx AS `Event Index`", "contingency AS `Contingency Name`", "from_bus AS `From Bus`", "to_bus AS `J Bus`", "line_id AS `CKT`", "rate_mva AS `Rating`", "loading_percent AS `Loading`", "viol AS `Violation`").write.option("header", True).csv(path)
    return files.accepted(files.read_flat(spark, path)).select(F.col("event_idx").cast("int").alias("event_idx"), F.col("from_bus").cast("int").alias("from_bus"), F.col("to_bus").cast("int").alias("to_bus"), "line_id", "loading_percent", "rate_mva")


@query("SELECT count(*) AS n_rows, count(CASE WHEN line_id <> '3' THEN 1 END) AS n_accepted, count(CASE WHEN line_id = '3' THEN 1 END) AS n_rejected, CAST(0 AS BIGINT) AS no_from_bus, CAST(0 AS BIGINT) AS no_to_bus, CAST(0 AS BIGINT) AS no_line_id, count(CASE WHEN line_id = '3' THEN 1 END) AS no_loading_percent FROM cases")
def reject_counts(spark, sf_dir):
    path = network.shared_path(spark, "csv")
    spark.table("cases").selectExpr("event_idx", "from_bus", "to_bus", "line_id AS circuit_id", "CASE WHEN line_id = '3' THEN 'n/a' ELSE CAST(loading_percent AS STRING) END AS loading_percent").write.option("header", True).csv(path)
    return files.reject_counts(files.read_flat(spark, path))


@query("SELECT event_id AS contingency, true AS success, 'none' AS violation, false AS isolated FROM events WHERE event_type = 'click' AND event_id % 2 = 0 UNION ALL SELECT event_id, false, 'voltage', true FROM events WHERE event_type = 'click' AND event_id % 2 = 1")
def success_log(spark, sf_dir):
    path = network.shared_path(spark, "log")
    spark.table("solver_lines").select(F.expr("CASE WHEN line LIKE 'contingency%' AND line_no % 2 = 1 THEN concat(upper(replace(line, 'true', 'false')), ' violation: Voltage warning: ISOLATED') ELSE line END").alias("value")).write.text(path)
    return files.success_log(spark.read.text(path))


@query("SELECT s_suppkey AS bus, s_nationkey AS area, s_acctbal AS load_mw FROM supplier WHERE s_suppkey % 10 <> 3")
def whitespace_table(spark, sf_dir):
    path = network.shared_path(spark, "txt")
    line = F.expr("concat('  ', s_suppkey, '   ', s_nationkey, ' ', CASE WHEN s_suppkey % 10 = 3 THEN 'n/a' ELSE CAST(s_acctbal AS STRING) END)")
    spark.table("supplier").select(line.alias("value")).write.text(path)
    return files.whitespace_table(spark.read.text(path), [("bus", "bigint"), ("area", "int"), ("load_mw", "double")])


@query(f"SELECT contingency, {_KEYS}, loading_percent FROM cases WHERE event_idx = 9")
def index_one_event(spark, sf_dir):
    """The bucketed index written from cases and one event read from it."""
    path = network.shared_path(spark, "index")
    files.write_index(spark.table("cases"), path)
    return files.read_event(spark, path, 9).select("contingency", *C.KEY, "loading_percent")


@query("""SELECT b.vec_id, round(0.5 * b.l / max(b.l) OVER () + 0.5 * (b.s - min(b.s) OVER ()) / (max(b.s) OVER () - min(b.s) OVER ()), 5) AS score FROM
 (SELECT e.vec_id, CAST(e.label AS DOUBLE) AS l, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q) b""")
def hybrid_rank(spark, sf_dir):
    """Here a vector's label stands for its text score."""
    vectors = spark.table("embeddings")
    return retrieval.hybrid(vectors.select("vec_id", F.col("label").cast("double").alias("score")), retrieval.cosine(vectors, 7), "vec_id")
