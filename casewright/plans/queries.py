"""Registered queries over the case data, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import columns as C
from casewright.operators import edits, network, ranking, retrieval, summaries
from casewright.sources import fixtures
from casewright.streaming import streams

QUERIES, ORACLE = {}, {}
_ABS = "abs(loading_percent)"
_KEYS = "from_bus, to_bus, line_id, section"
_CK = "concat(from_bus, '|', to_bus, '|', line_id, '|', section)"
_USABLE = "(SELECT * FROM cases WHERE event_idx NOT IN (SELECT event_idx FROM convergence WHERE converged = 'false'))"
_DEC = "CAST(sum(CAST({0} AS DECIMAL(18,5))) AS DOUBLE)"


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir) -> DataFrame:
            fixtures.register(spark, sf_dir)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = fixtures.with_views(sql)
        return f

    return add


_AT = "(min(struct_pack(x := {0}, e := event_idx, c := contingency)))"
_BRANCH = f"""SELECT *, min_loading - base_loading AS min_deviation, max_loading - base_loading AS max_deviation FROM (SELECT {_KEYS}, count(*) AS case_count, {_DEC.format('loading_percent')} / count(*) AS mean_loading, min(loading_percent) AS min_loading,
 max(loading_percent) AS max_loading, max({_ABS}) AS max_abs_loading, max(CASE WHEN event_idx = 0 THEN loading_percent END) AS base_loading,
 count(CASE WHEN viol = 1 OR loading_percent >= 100 THEN 1 END) AS overload_count, count(CASE WHEN {_ABS} >= 100 THEN 1 END) AS thermal_count,
 (min(struct_pack(e := event_idx, c := contingency, r := rate_mva))).r AS rate_mva, {_AT.format('-' + _ABS)}.c AS binding_contingency,
 {_AT.format('loading_percent')}.e AS min_event, {_AT.format('-loading_percent')}.e AS max_event, {_AT.format('-' + _ABS)}.e AS binding_event
 FROM {_USABLE} GROUP BY {_KEYS})"""


@query(_BRANCH)
def branch_summary(spark, sf_dir):
    return summaries.branch_summary(summaries.usable(spark.table("cases"), spark.table("convergence")))


@query(_BRANCH.replace("event_idx = 0 THEN", "event_idx IS NULL OR event_idx = 2 THEN").replace(_USABLE, "(SELECT nullif(event_idx, 0) AS event_idx, CASE event_idx WHEN 0 THEN ' Base-Case ' WHEN 2 THEN 'BASECASE' ELSE contingency END AS contingency, from_bus, to_bus, line_id, section, loading_percent, rate_mva, viol FROM cases)").replace("e := event_idx", "n := event_idx IS NULL, e := event_idx").replace("(min(struct_pack(n := event_idx IS NULL, e := event_idx, c := contingency, r := rate_mva))).r", "(min(struct_pack(n := event_idx IS NULL, e := event_idx, c := contingency, r := rate_mva)) FILTER (event_idx IS NULL OR event_idx % 3 <> 1)).r"))
def branch_summary_words(spark, sf_dir):
    """Base cases known by their names, violations in words and numbers, and ratings missing from a third of the cases."""
    said = F.expr("CASE WHEN viol = 1 THEN element_at(array('Yes', ' 2.5', 'TRUE', 'converged'), event_idx % 4 + 1) ELSE element_at(array('no', '0.0', '', 'failed', 'n/a'), event_idx % 5 + 1) END")
    name = F.expr("CASE event_idx WHEN 0 THEN ' Base-Case ' WHEN 2 THEN 'BASECASE' ELSE contingency END")
    rate = F.expr("CASE WHEN event_idx % 3 = 1 THEN NULL ELSE rate_mva END")
    cases = spark.table("cases").select("event_idx", name.alias("contingency"), *C.KEY, "loading_percent", rate.alias("rate_mva"), said.alias("viol"))
    return summaries.branch_summary(cases.withColumn("event_idx", F.expr("nullif(event_idx, 0)")))


_CONTINGENCY = f"""SELECT event_idx, contingency, count(*) AS facilities, count(CASE WHEN viol = 1 THEN 1 END) AS violations, max({_ABS}) AS max_abs_loading,
 count(CASE WHEN {_ABS} >= 100 THEN 1 END) AS thermal_count,
 (min(struct_pack(a := -{_ABS}, b := from_bus, c := to_bus, d := line_id, e := section, k := {_CK}))).k AS worst_facility FROM cases GROUP BY event_idx, contingency"""


@query(_CONTINGENCY)
def contingency_summary(spark, sf_dir):
    return summaries.contingency_summary(spark.table("cases"))


@query(f"SELECT event_idx, {_KEYS}, loading_percent, {_ABS} AS value FROM cases ORDER BY value DESC, event_idx, {_KEYS}, loading_percent DESC LIMIT 10")
def topk_cases(spark, sf_dir):
    value = F.abs("loading_percent")
    return spark.table("cases").select("event_idx", *C.KEY, "loading_percent", value.alias("value")).orderBy(F.desc("value"), "event_idx", *C.KEY, F.desc("loading_percent")).limit(10)


@query(f"""SELECT {_KEYS}, (min(struct_pack(a := -{_ABS}, e := event_idx, c := contingency))).c AS contingency, max({_ABS}) AS value FROM cases GROUP BY {_KEYS}""")
def binding_case(spark, sf_dir):
    value = F.abs("loading_percent")
    return spark.table("cases").groupBy(*C.KEY).agg(F.min_by("contingency", F.struct(-value, "event_idx", "contingency")).alias("contingency"), F.max(value).alias("value"))


@query("SELECT count(*) AS total, count(CASE WHEN converged = 'true' THEN 1 END) AS converged, count(CASE WHEN converged = 'false' THEN 1 END) AS failed FROM convergence")
def convergence_counts(spark, sf_dir):
    ok = C.lenient_bool(F.col("converged"))
    return spark.table("convergence").agg(F.count("*").alias("total"), F.count_if(ok).alias("converged"), F.count_if(~ok).alias("failed"))


@query("SELECT status_code, count(*) AS n, CAST(sum(iterations) AS BIGINT) AS iterations FROM convergence GROUP BY status_code")
def success_metrics(spark, sf_dir):
    return spark.table("convergence").groupBy("status_code").agg(F.count("*").alias("n"), F.sum("iterations").alias("iterations"))


@query(f"""SELECT coalesce(s.event_idx, c.event_idx) AS event_idx, coalesce(s.contingency, c.contingency) AS contingency, s.facilities, s.max_abs_loading, c.converged = 'true' AS converged, c.status_code
 FROM (SELECT event_idx, contingency, count(*) AS facilities, max({_ABS}) AS max_abs_loading FROM cases WHERE event_idx <> 0 GROUP BY ALL) s FULL JOIN convergence c ON s.event_idx = c.event_idx AND s.contingency = c.contingency""")
def contingency_records(spark, sf_dir):
    s = summaries.contingency_summary(spark.table("cases").where("event_idx <> 0")).select("event_idx", "contingency", "facilities", "max_abs_loading")
    c = spark.table("convergence").select("event_idx", "contingency", C.lenient_bool(F.col("converged")).alias("converged"), "status_code")
    return s.join(c, ["event_idx", "contingency"], "full")


def _stats(value: str) -> str:
    return f"""count({value}) AS n, {_DEC.format(value)} AS total, {_DEC.format(value)} / count({value}) AS mean, quantile_cont({value}, 0.5) AS median, min({value}) AS low, max({value}) AS high,
 round(stddev_pop({value}), 6) AS sd, round(var_pop({value}), 4) AS variance, quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr"""


@query(f"SELECT coalesce(line_id, 'unknown') AS label, {_stats('loading_percent')} FROM cases GROUP BY 1")
def group_statistics(spark, sf_dir):
    return summaries.by_group(spark.table("cases"), "line_id", F.col("loading_percent"))


@query(f"SELECT contingency AS label, {_stats('loading_percent')} FROM cases GROUP BY 1")
def group_cases_contingency(spark, sf_dir):
    return summaries.by_group(spark.table("cases"), "contingency", F.col("loading_percent"))


@query(f"SELECT a.area_name AS label, {_stats('loading_percent')} FROM cases JOIN buses b ON b.bus_id = from_bus JOIN areas a ON a.area = b.area GROUP BY 1")
def group_cases_area(spark, sf_dir):
    named = spark.table("cases").join(spark.table("buses").join(spark.table("areas"), "area"), F.col("from_bus") == F.col("bus_id"))
    return summaries.by_group(named, "area_name", F.col("loading_percent"))


_MELTED = "(SELECT * FROM (SELECT 'line_id' AS variable, line_id AS label, loading_percent, ang_from_deg FROM cases UNION ALL SELECT 'contingency', contingency, loading_percent, ang_from_deg FROM cases) UNPIVOT (value FOR metric IN (loading_percent, ang_from_deg)))"


@query(f"""SELECT variable, label, metric, count(value) AS n, {_DEC.format('value')} / count(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, min(value) AS low, max(value) AS high FROM {_MELTED} GROUP BY ALL""")
def distribution_summary(spark, sf_dir):
    """Every variable by every metric in one pass: rows are melted, not read again."""
    return summaries.distributions(spark.table("cases"), ["line_id", "contingency"], ["loading_percent", "ang_from_deg"])


@query("SELECT event_idx, abs(loading_percent) AS abs_loading, least(v_from_pu, v_to_pu) AS low_voltage, abs(ang_from_deg - ang_to_deg) AS angle_difference FROM cases")
def case_metrics(spark, sf_dir):
    return spark.table("cases").select("event_idx", *(c.alias(n) for n, c in C.case_metrics().items()))


@query(f"SELECT {_CK} AS key, count(*) AS n FROM cases GROUP BY 1")
def case_key(spark, sf_dir):
    return spark.table("cases").groupBy(C.case_key().alias("key")).agg(F.count("*").alias("n"))


@query("SELECT from_bus, event_idx, loading_percent FROM cases WHERE loading_percent >= 90 AND v_to_pu < 0.95 AND event_idx IN (1, 2, 3, 5, 8)")
def case_conditions(spark, sf_dir):
    return spark.table("cases").where("loading_percent >= 90 AND v_to_pu < 0.95 AND event_idx IN (1, 2, 3, 5, 8)").select("from_bus", "event_idx", "loading_percent")


_CLASS = "CASE WHEN {0} IS NULL THEN 'unknown' " + " ".join(f"WHEN {{0}} < {edge} THEN '{name}'" for edge, name in C.VOLTAGE_BANDS) + f" ELSE '{C.TOP_BAND}' END"


@query(f"SELECT bus_id, {_CLASS.format('base_kv')} AS voltage_class FROM buses")
def voltage_class(spark, sf_dir):
    return spark.table("buses").select("bus_id", C.voltage_class(F.col("base_kv")).alias("voltage_class"))


@query("SELECT c.from_bus, c.to_bus, CASE WHEN f.base_kv IS NULL OR t.base_kv IS NULL THEN 'unknown' WHEN abs(f.base_kv - t.base_kv) <= 0.5 THEN 'same' WHEN t.base_kv > f.base_kv THEN 'up' ELSE 'down' END AS step, count(*) AS n FROM cases c LEFT JOIN buses f ON f.bus_id = c.from_bus LEFT JOIN buses t ON t.bus_id = c.to_bus GROUP BY ALL")
def transformer_step(spark, sf_dir):
    b = spark.table("buses").select("bus_id", "base_kv")
    ends = spark.table("cases").join(b.toDF("from_bus", "f"), "from_bus", "left").join(b.toDF("to_bus", "t"), "to_bus", "left")
    return ends.groupBy("from_bus", "to_bus", C.transformer_step(F.col("f"), F.col("t")).alias("step")).agg(F.count("*").alias("n"))


@query("SELECT b.bus_id, b.bus_name, b.base_kv, a.area_name FROM buses b LEFT JOIN areas a ON a.area = b.area")
def bus_enrich(spark, sf_dir):
    return spark.table("buses").join(spark.table("areas"), "area", "left").select("bus_id", "bus_name", "base_kv", "area_name")


@query(f"""SELECT DISTINCT {_KEYS}, f.bus_name AS from_name, t.bus_name AS to_name, greatest(f.base_kv, t.base_kv) AS high_kv, CASE WHEN f.area = t.area THEN fa.area_name ELSE concat(fa.area_name, ' / ', ta.area_name) END AS area_label
 FROM branch_metadata LEFT JOIN buses f ON f.bus_id = from_bus LEFT JOIN areas fa ON fa.area = f.area LEFT JOIN buses t ON t.bus_id = to_bus LEFT JOIN areas ta ON ta.area = t.area""")
def branch_enrich(spark, sf_dir):
    b = spark.table("buses").join(spark.table("areas"), "area", "left").select("bus_id", "bus_name", "base_kv", "area_name")
    ends = spark.table("branch_metadata").join(b.toDF("from_bus", "from_name", "f_kv", "f_area"), "from_bus", "left").join(b.toDF("to_bus", "to_name", "t_kv", "t_area"), "to_bus", "left")
    label = F.when(F.col("f_area") == F.col("t_area"), F.col("f_area")).otherwise(F.concat_ws(" / ", "f_area", "t_area"))
    return ends.select(*C.KEY, "from_name", "to_name", F.greatest("f_kv", "t_kv").alias("high_kv"), label.alias("area_label")).distinct()


@query("SELECT from_bus, to_bus, line_id, concat(from_bus, ' to ', to_bus, ' (', line_id, ')') AS label FROM branch_metadata")
def facility_label(spark, sf_dir):
    return spark.table("branch_metadata").select("from_bus", "to_bus", "line_id", C.facility_label(F.col("from_bus").cast("string"), F.col("to_bus").cast("string"), F.col("line_id"), F.col("section")).alias("label"))


_FAC = f"SELECT {_KEYS}, max({_ABS}) AS value, max(rate_mva) AS rate FROM cases GROUP BY ALL"


@query(f"SELECT {_KEYS}, v AS value, CASE WHEN v IS NOT NULL THEN row_number() OVER (ORDER BY v DESC NULLS LAST, {_KEYS}) END AS rank FROM (SELECT *, CASE WHEN rate > 0 THEN value END AS v FROM ({_FAC}))")
def rank_facilities(spark, sf_dir):
    v = F.when(F.max("rate_mva") > 0, F.max(F.abs("loading_percent")))
    out = spark.table("cases").groupBy(*C.KEY).agg(v.alias("value"))
    ranked = ranking.numbered(out, [F.col("value").desc_nulls_last(), *C.KEY], "rank")
    return ranked.withColumn("rank", F.when(F.col("value").isNotNull(), F.col("rank")))


@query(f"SELECT {_KEYS}, rate_mva, raw_branch_type FROM branch_metadata JOIN buses f ON f.bus_id = from_bus JOIN buses t ON t.bus_id = to_bus WHERE raw_branch_type IN ('nontransformer_branch', 'two_winding_transformer_branch') AND greatest(f.base_kv, t.base_kv) >= 50 AND rate_mva > 0")
def facility_rows(spark, sf_dir):
    b = spark.table("buses").select("bus_id", "base_kv")
    ends = spark.table("branch_metadata").join(b.toDF("from_bus", "f"), "from_bus").join(b.toDF("to_bus", "t"), "to_bus")
    kind = F.coalesce("raw_branch_type", F.lit("nontransformer_branch"))
    return ends.where(kind.isin("nontransformer_branch", "two_winding_transformer_branch") & (F.greatest("f", "t") >= 50) & (F.col("rate_mva") > 0)).select(*C.KEY, "rate_mva", "raw_branch_type")


@query("SELECT count(*) AS total, count(CASE WHEN rate_mva > 0 THEN 1 END) AS rated, count(CASE WHEN rate_mva > 0 THEN NULL ELSE 1 END) AS unrated FROM branch_metadata")
def facility_scope(spark, sf_dir):
    return spark.table("branch_metadata").agg(F.count("*").alias("total"), F.count_if(F.expr("rate_mva > 0")).alias("rated"), F.count_if(~F.coalesce(F.expr("rate_mva > 0"), F.lit(False))).alias("unrated"))


_A = "SELECT from_bus, to_bus, line_id, section, max(loading_percent) AS v, max(rate_mva) AS r FROM {0} GROUP BY ALL"


def _runs(spark):
    side = lambda t, s: spark.table(t).groupBy(*C.KEY).agg(F.max("loading_percent").alias(f"v_{s}"), F.max("rate_mva").alias(f"r_{s}"))
    return side("cases", "before"), side("cases_b", "after")


@query(f"SELECT {_KEYS}, a.v AS v_before, b.v AS v_after, b.v - a.v AS change, a.r <> b.r AS rating_changed FROM ({_A.format('cases')}) a JOIN ({_A.format('cases_b')}) b USING ({_KEYS})")
def compare_runs(spark, sf_dir):
    a, b = _runs(spark)
    return a.join(b, list(C.KEY)).select(*C.KEY, "v_before", "v_after", (F.col("v_after") - F.col("v_before")).alias("change"), (F.col("r_before") != F.col("r_after")).alias("rating_changed"))


@query(f"SELECT {_KEYS}, a.v AS v_before, b.v AS v_after FROM ({_A.format('cases')}) a JOIN ({_A.format('cases_b')}) b USING ({_KEYS}) WHERE a.v < 100 AND b.v >= 100")
def new_overloads(spark, sf_dir):
    a, b = _runs(spark)
    return a.join(b, list(C.KEY)).where("v_before < 100 AND v_after >= 100").select(*C.KEY, "v_before", "v_after")


@query(f"SELECT {_KEYS}, a.v AS v_before, b.v AS v_after FROM ({_A.format('cases')}) a JOIN ({_A.format('cases_b')}) b USING ({_KEYS}) WHERE a.v >= 100 AND b.v < 100")
def resolved_overloads(spark, sf_dir):
    a, b = _runs(spark)
    return a.join(b, list(C.KEY)).where("v_before >= 100 AND v_after < 100").select(*C.KEY, "v_before", "v_after")


@query(f"SELECT DISTINCT {_KEYS} FROM cases EXCEPT SELECT {_KEYS} FROM cases_b")
def only_in_run(spark, sf_dir):
    a, b = _runs(spark)
    return a.join(b, list(C.KEY), "left_anti").select(*C.KEY)


@query(f"SELECT event_idx, CAST(sum(CAST(CASE WHEN f.area = 0 THEN p_from_mw ELSE -p_from_mw END AS DECIMAL(18,6))) AS DOUBLE) AS flow_mw FROM cases JOIN buses f ON f.bus_id = from_bus JOIN buses t ON t.bus_id = to_bus WHERE (f.area = 0 AND t.area = 1) OR (f.area = 1 AND t.area = 0) GROUP BY event_idx")
def interface_flow(spark, sf_dir):
    return summaries.interface_flow(spark.table("cases"), spark.table("buses"), 0, 1)


@query("SELECT bin, count(*) AS n, min(v) AS low, max(v) AS high FROM (SELECT v, greatest(1, len(list_filter(e, lambda x: x < v))) AS bin FROM (SELECT l_quantity AS v FROM lineitem), (SELECT list_distinct(quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM lineitem)) GROUP BY bin")
def quantile_bins(spark, sf_dir):
    out = summaries.quantile_bins(spark.table("lineitem").select(F.col("l_quantity").alias("v")), "v")
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("WITH o AS (SELECT CAST(abs(s_acctbal) AS DECIMAL(18,5)) AS v FROM supplier), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM o) SELECT round(CAST(2 * sum(v * i) / (max(n) * sum(v)) AS DOUBLE) - (max(n) + 1) / max(n), 6) AS gini FROM r".replace("WITH o", ", o", 1))
def gini(spark, sf_dir):
    return summaries.gini(spark.table("supplier").select(F.abs("s_acctbal").alias("v")), "v")


@query(f"SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, {_DEC.format('value')} AS total, {_DEC.format('value')} / count(value) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def stream_group_stats(spark, sf_dir):
    return streams.stream_to_table(spark, f"{sf_dir}/events.parquet", "casewright_group_stats")


@query("""SELECT session, event_id, ts, (SELECT min(b.ts) FROM audit b WHERE b.session = a.session AND b.kind = 'user' AND b.ts > a.ts) AS next_ts FROM audit a WHERE kind = 'user'""")
def turn_boundaries(spark, sf_dir):
    users = spark.table("audit").where("kind = 'user'")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("session").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    return users.withColumn("us", micros).select("session", "event_id", "ts", F.min("ts").over(w).alias("next_ts"))


@query("SELECT session, tool, count(*) AS calls, " + _DEC.format("seconds") + " AS seconds FROM audit WHERE kind = 'call' GROUP BY ALL")
def session_totals(spark, sf_dir):
    return spark.table("audit").where("kind = 'call'").groupBy("session", "tool").agg(F.count("*").alias("calls"), F.sum(F.col("seconds").cast("decimal(18,5)")).cast("double").alias("seconds"))


_MARK = "CASE WHEN line LIKE 'contingency:%' THEN 'case' WHEN line LIKE 'Controller%' THEN 'iteration' WHEN line LIKE 'Power flow%' THEN 'flow' END"


@query(f"""SELECT m.run_id, f.family, count(CASE WHEN {_MARK} = f.family THEN 1 END) AS seen, max(try_cast(nullif(regexp_extract(line, 'analyze: ([0-9]+)', 1), '') AS BIGINT)) AS announced
 FROM solver_lines m JOIN (SELECT run_id, arg_min({_MARK}, line_no) FILTER ({_MARK} IS NOT NULL) AS family FROM solver_lines GROUP BY run_id) f ON f.run_id = m.run_id GROUP BY ALL""")
def run_progress(spark, sf_dir):
    lines = spark.table("solver_lines").withColumn("mark", F.expr(_MARK))
    first = lines.groupBy("run_id").agg(F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("family"))
    total = F.regexp_extract("line", r"analyze: ([0-9]+)", 1).try_cast("bigint")
    return lines.join(first, "run_id").groupBy("run_id", "family").agg(F.count_if(F.col("mark") == F.col("family")).alias("seen"), F.max(total).alias("announced"))


@query("""SELECT a.bus AS bus, coalesce(min(l.m), a.bus) AS island FROM net_bus a LEFT JOIN reach l ON l.r = a.bus WHERE a.ide <> 4 GROUP BY a.bus""")
def islands(spark, sf_dir):
    live = network.in_service(spark.table("net_bus"), spark.table("net_element"))
    return network.islands(spark.table("net_bus"), live)


_EDGES = "edge AS (SELECT i AS a, j AS b FROM net_element WHERE st = 1 AND i NOT IN (SELECT bus FROM net_bus WHERE ide = 4) AND j NOT IN (SELECT bus FROM net_bus WHERE ide = 4)), two AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge)"
ORACLE["islands"] = ORACLE["islands"].replace("WITH buses", "WITH RECURSIVE buses", 1).replace("\nSELECT a.bus", f",\n{_EDGES}, reach(r, m) AS (SELECT bus, bus FROM net_bus WHERE ide <> 4 UNION SELECT two.b, reach.m FROM reach JOIN two ON two.a = reach.r)\nSELECT a.bus", 1)


@query("SELECT r AS bus, min(h) AS hops FROM reach GROUP BY r")
def k_hop(spark, sf_dir):
    live = network.in_service(spark.table("net_bus"), spark.table("net_element"))
    return network.k_hop(live, 1, 3)


ORACLE["k_hop"] = ORACLE["k_hop"].replace("WITH buses", "WITH RECURSIVE buses", 1).replace("\nSELECT r AS bus", f",\n{_EDGES}, reach(r, h) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT two.b, reach.h + 1 FROM reach JOIN two ON two.a = reach.r WHERE reach.h < 3)\nSELECT r AS bus", 1)


@query("SELECT bus, sum(load_mw) AS load_mw, CAST(sum(generation_mw) AS DOUBLE) AS generation_mw FROM net_bus WHERE ide <> 4 GROUP BY bus")
def bus_injections(spark, sf_dir):
    return network.injections(spark.table("net_bus"))


@query("SELECT area, " + _DEC.format("load_mw") + " AS load_mw, " + _DEC.format("generation_mw") + " AS generation_mw FROM net_bus GROUP BY GROUPING SETS ((area), ())")
def raw_totals(spark, sf_dir):
    total = lambda c: F.sum(F.col(c).cast("decimal(18,5)")).cast("double").alias(c)
    return spark.table("net_bus").groupingSets([["area"], []], "area").agg(total("load_mw"), total("generation_mw"))


@query("SELECT bus, CASE WHEN area = 3 AND ide <> 4 THEN load_mw * 1.5 ELSE load_mw END AS load_mw FROM net_bus")
def edit_scale(spark, sf_dir):
    return edits.scaled(spark.table("net_bus"), 3, "load_mw", factor=1.5).select("bus", "load_mw")


@query("SELECT i, j, ckt, st FROM net_element WHERE NOT (i % 11 = 0 AND ckt = '1')")
def edit_remove(spark, sf_dir):
    gone = spark.table("net_element").where("i % 11 = 0 AND ckt = '1'").select("i", "j", "ckt")
    return spark.table("net_element").join(gone, ["i", "j", "ckt"], "left_anti").select("i", "j", "ckt", "st")


_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[.\-/][a-z0-9]+)*'), lambda x: true)"
_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_ALL = f"(SELECT doc_id, list_filter(list_concat(w, flatten(list_transform(list_filter(w, lambda x: regexp_matches(x, '[.\\-/]')), lambda x: regexp_split_to_array(x, '[.\\-/]')))), lambda x: x NOT IN ({_STOP})) AS t FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))"


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {_ALL}) GROUP BY ALL")
def postings(spark, sf_dir):
    return retrieval.postings(spark.table("documents"))


@query(f"""SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM
 (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM {_ALL}) WHERE term IN ('license', 'thon', 'der') GROUP BY ALL)),
 (SELECT count(*) AS n, avg(len(t)) AS a FROM {_ALL}) GROUP BY doc_id""")
def bm25(spark, sf_dir):
    return retrieval.bm25(spark.table("documents"), ["license", "thon", "der"])


@query("SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q")
def vector_similarity(spark, sf_dir):
    return retrieval.similarity(spark.table("embeddings"), 7)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def distinct_documents(spark, sf_dir):
    return spark.table("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")
