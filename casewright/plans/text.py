"""Registered queries over names, cells, labels, files, headings and scoped retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import names as N
from casewright.operators import network, outages, ranking, retrieval, trees
from casewright.plans.queries import _ABS, _ALL, _DEC, _KEYS, query
from casewright.plans.wider import _PARTS, _network
from casewright.sources import documents, files

_NAME = r"trim(regexp_replace(regexp_replace(lower({0}), '~[0-9]+(\s|$)', '\1', 'g'), '[^\pL\pN_]+', ' ', 'g'))"
_STORED = "CASE p_partkey % 3 WHEN 0 THEN concat(upper(p_name), ' ') WHEN 1 THEN concat(left(p_name, 7), '~1') ELSE concat(p_name, '-', p_size) END"


@query(f"""SELECT q AS query, p_partkey, match, CAST(CASE match WHEN 'exact' THEN 1 WHEN 'prefix' THEN 2 ELSE 3 END AS INT) AS place FROM (
 SELECT q, p_partkey, CASE WHEN trim(stored) = trim(q) OR name = wanted THEN 'exact' WHEN starts_with(name, wanted) THEN 'prefix'
  WHEN length(wanted) >= 3 AND (((contains(trim(stored), '~') OR length(trim(stored)) >= 12) AND starts_with(wanted, name)) OR len(list_filter(string_split(wanted, ' '), lambda t: len(list_filter(string_split(name, ' '), lambda w: starts_with(w, t))) = 0)) = 0) THEN 'fuzzy' END AS match
 FROM (SELECT p_partkey, stored, {_NAME.format('stored')} AS name FROM (SELECT p_partkey, {_STORED} AS stored FROM part)), (SELECT q, {_NAME.format('q')} AS wanted FROM (SELECT unnest(['small ring', 'Red', 'b bolt', 'blue bolt 7', 'small widget']) AS q))) WHERE match IS NOT NULL""")
def name_match(spark, sf_dir):
    """Part names, padded, cut or with a number behind, matched against a few queries."""
    stored = spark.table("part").select("p_partkey", F.expr(_STORED).alias("stored"))
    asked = spark.createDataFrame([(q,) for q in ("small ring", "Red", "b bolt", "blue bolt 7", "small widget")], "query string")
    return N.best_matches(stored, asked, "stored").select("query", "p_partkey", "match", "place")


@query("""SELECT p_partkey, size, p_brand FROM (SELECT p_partkey, p_brand, p_name, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE concat(' ', p_size, '.0') END AS size FROM part)
 WHERE coalesce(CAST(try_cast(trim(size) AS DOUBLE) > 9 AS BOOLEAN), lower(trim(size)) > '9') AND lower(trim(p_brand)) <> 'brand#1' AND contains(lower(p_name), 'ring') AND p_partkey % 7 IN (1, 2)""")
def typed_filters(spark, sf_dir):
    """Filters on text cells: numbers where both sides are, else folded text; the columns are checked by name."""
    table = spark.table("part").select("p_partkey", "p_brand", "p_name", F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE concat(' ', p_size, '.0') END").alias("size"), F.expr("concat(p_partkey % 7, '.0')").alias("left"))
    return N.filtered(table, [("size", ">", 9), ("p_brand", "!=", "BRAND#1 "), ("p_name", "contains", "Ring"), ("left", "in", [1, "2"])], ["p_partkey", "size", "p_brand"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 4 <> 3")
def join_by_key(spark, sf_dir):
    """Keys written as 7.0, ' 7 ' or words in other letters meet 7 and their word."""
    c = spark.table("customer").select("c_custkey", F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(c_nationkey, '.0') WHEN 1 THEN concat(' ', c_nationkey, ' ') WHEN 2 THEN concat('Key  ', c_nationkey) ELSE 'none' END").alias("k"))
    n = spark.table("nation").select("n_name", F.explode(F.expr("array(CAST(n_nationkey AS STRING), concat('KEY ', n_nationkey))")).alias("nk"))
    return c.withColumn("_k", N.join_key(F.col("k"))).join(n.withColumn("_n", N.join_key(F.col("nk"))), F.expr("_k = _n"), "left").select("c_custkey", "n_name")


_RE = ["^#{1,6}\\s+(.{1,100})$", "^([A-H]\\.\\s+[A-Z][A-Za-z,&/ -]{2,70})$", "^((?:Attachment|Appendix|Table|Section|Part|Chapter|Exhibit)\\s+[0-9A-Z]+(?:\\.\\d+)*\\b[^.;]{0,80})$", "^(\\d+(?:\\.\\d+){0,4}\\.?\\s+[A-Z][^.;,]{1,80})$"]
_LINE = "CASE p_partkey % 8 WHEN 0 THEN concat('R', p_size, '.1. Each ', p_name) WHEN 1 THEN concat('## ', p_name) WHEN 2 THEN concat('B.  ', upper(p_name)) WHEN 3 THEN concat('Table ', p_size, ' of  ', p_name) WHEN 4 THEN concat(p_size, '.2 ', upper(p_name)) WHEN 5 THEN concat(p_size, '.2 ', p_name) WHEN 6 THEN concat('Table ', p_size, '; ', p_name) ELSE p_name END"
_SAID = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in _RE) + ", '')"


@query(f"SELECT p_partkey, trim(CASE WHEN regexp_extract(t, '^([RM]\\d+(?:\\.\\d+)*)\\.?(?:\\s+[A-Z(].*)?$', 1) <> '' THEN regexp_extract(t, '^([RM]\\d+(?:\\.\\d+)*)\\.?(?:\\s+[A-Z(].*)?$', 1) ELSE {_SAID} END) AS section FROM (SELECT p_partkey, trim(regexp_replace({_LINE}, '\\s+', ' ', 'g')) AS t FROM part)")
def headings(spark, sf_dir):
    return spark.table("part").select("p_partkey", N.heading(F.expr(_LINE)).alias("section"))


_SCOPE = _ALL.replace("FROM documents", "FROM documents WHERE contains(lower(source), 'src1')")


@query(f"""SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM
 (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM {_SCOPE}) WHERE term IN ('license', 'thon', 'der') GROUP BY ALL)),
 (SELECT count(*) AS n, avg(len(t)) AS a FROM {_SCOPE}) GROUP BY doc_id""")
def bm25_scoped(spark, sf_dir):
    return retrieval.bm25(retrieval.scoped(spark.table("documents"), "SRC1"), ["license", "thon", "der"])


@query(f"""SELECT doc_id, round(0.5 * coalesce(score, 0) / max(score) OVER () + 0.5 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 5) AS score FROM
 (SELECT e.vec_id AS doc_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id IN (SELECT doc_id FROM documents)) v
 LEFT JOIN (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM
 (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM {_ALL}) WHERE term IN ('license', 'thon', 'der') GROUP BY ALL)),
 (SELECT count(*) AS n, avg(len(t)) AS a FROM {_ALL}) GROUP BY doc_id) b USING (doc_id)""")
def hybrid_search(spark, sf_dir):
    """BM25 of the documents and the similarity of their vectors; a document without a query term scores 0 in text."""
    d = spark.table("documents")
    similar = retrieval.cosine(spark.table("embeddings"), 7).select(F.col("vec_id").alias("doc_id"), "similarity").join(d.select("doc_id"), "doc_id", "left_semi")
    scored = d.select("doc_id").join(retrieval.bm25(d, ["license", "thon", "der"]), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return retrieval.hybrid(scored, similar, "doc_id")


# labels and amounts

_META = "branch_metadata m LEFT JOIN buses f ON f.bus_id = from_bus LEFT JOIN buses t ON t.bus_id = to_bus AND to_bus % 5 <> 0"
_BAND = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 50 THEN '<50 kV' WHEN {0} < 100 THEN '50-99 kV' WHEN {0} < 230 THEN '100-229 kV' WHEN {0} < 345 THEN '230-344 kV' WHEN {0} < 500 THEN '345-499 kV' ELSE '500+ kV' END"


def _ends(spark):
    b = spark.table("buses")
    near = b.select(F.col("bus_id").alias("from_bus"), F.col("base_kv").alias("f_kv"), F.col("area").alias("f_area"))
    far = b.where("bus_id % 5 <> 0").select(F.col("bus_id").alias("to_bus"), F.col("base_kv").alias("t_kv"), F.col("area").alias("t_area"))
    return spark.table("branch_metadata").join(near, "from_bus", "left").join(far, "to_bus", "left")


@query(f"""SELECT {_KEYS}, CASE WHEN raw_branch_type <> 'nontransformer_branch' THEN CASE WHEN f.base_kv IS NULL OR t.base_kv IS NULL THEN 'unknown' WHEN abs(f.base_kv - t.base_kv) <= 0.5 THEN 'same' WHEN t.base_kv > f.base_kv THEN 'up' ELSE 'down' END
 ELSE coalesce({_BAND.format('greatest(f.base_kv, t.base_kv)')}, 'stored') END AS voltage_group FROM {_META}""")
def utilization_voltage_group(spark, sf_dir):
    return _ends(spark).select(*C.KEY, C.utilization_group(F.col("raw_branch_type"), F.col("f_kv"), F.col("t_kv"), F.lit("stored")).alias("voltage_group"))


@query("""SELECT s_suppkey AS bus, CASE WHEN s_nationkey % 4 = 3 THEN CAST(s_nationkey AS VARCHAR) WHEN n > 1 THEN concat('GROUP ', s_nationkey % 4, ' (', s_nationkey, ')') ELSE concat('GROUP ', s_nationkey % 4) END AS label FROM supplier,
 (SELECT s_nationkey % 4 AS g, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1) WHERE g = s_nationkey % 4""")
def end_area_labels(spark, sf_dir):
    """Areas of buses; several areas share a name and some have none."""
    areas = spark.table("net_bus").select("area").distinct().select("area", F.expr("CASE WHEN area % 4 = 3 THEN ' ' ELSE concat('GROUP  ', area % 4) END").alias("name"))
    shared = areas.groupBy("name").agg((F.count("*") > 1).alias("shared"))
    labels = areas.join(shared, "name").select("area", C.end_area_label(F.col("area"), F.col("name"), F.col("shared")).alias("label"))
    return spark.table("net_bus").select("bus", "area").join(labels, "area").select("bus", "label")


@query(f"SELECT {_KEYS}, f.area IS NOT NULL AND t.area IS NOT NULL AND f.area <> t.area AS tie FROM {_META}")
def tie_flag(spark, sf_dir):
    return _ends(spark).select(*C.KEY, F.coalesce(C.tie_flag(F.array(F.col("f_area").cast("string"), F.col("t_area").cast("string"))), F.lit(False)).alias("tie"))


@query("SELECT event_idx, from_bus, to_bus, line_id, p_from_mw, coalesce(CASE WHEN line_id = '3' THEN loading_percent END, CASE WHEN rate_mva > 0 THEN p_from_mw / rate_mva * 100 END) AS pct FROM cases")
def utilization_pct(spark, sf_dir):
    """A reported percentage wins; without a positive rating there is none."""
    reported = F.when(F.col("line_id") == "3", F.col("loading_percent"))
    return spark.table("cases").select("event_idx", "from_bus", "to_bus", "line_id", "p_from_mw", C.percent_of_rating(F.col("p_from_mw"), F.col("rate_mva"), reported).alias("pct"))


@query(f"SELECT {_KEYS}, rate_mva FROM {_META} WHERE f.area = 2 OR t.area = 2")
def area_filter(spark, sf_dir):
    """Facilities with either end in an area, by its id or its name in other letters."""
    named = F.array(F.col("f_area").cast("string"), F.col("t_area").cast("string"), F.concat(F.lit("Area "), F.col("f_area")), F.concat(F.lit("Area "), F.col("t_area")))
    return _ends(spark).where(N.in_area(named, " AREA 2")).select(*C.KEY, "rate_mva")


@query("""SELECT c.contingency, coalesce(list_sort(list(DISTINCT CAST(area AS VARCHAR)) FILTER (area IS NOT NULL)), []) AS areas FROM (SELECT DISTINCT contingency, unnest(CASE WHEN contingency = 'base_case' THEN [NULL] ELSE list_transform(regexp_extract_all(contingency, '[0-9]+'), lambda x: CAST(x AS INT))[1:CASE WHEN contingency LIKE 'BR%' THEN 2 ELSE 1 END] END) AS bus FROM cases) c LEFT JOIN buses b ON b.bus_id = c.bus AND c.bus % 9 <> 0 GROUP BY c.contingency""")
def outage_areas(spark, sf_dir):
    """Areas of the buses that an outage's name says it takes out, in several forms of names; an empty list where none is known."""
    said = F.expr("CASE WHEN event_idx % 3 = 0 THEN lower(contingency) WHEN event_idx % 3 = 1 THEN replace(replace(contingency, 'BR_', 'BRANCH_'), 'GN_', 'Gen_') ELSE contingency END")
    buses = spark.table("cases").select("event_idx", "contingency").distinct().select("contingency", F.explode_outer(C.outage_buses(said)).alias("bus"))
    area = spark.table("buses").where("bus_id % 9 <> 0").select(F.col("bus_id").alias("bus"), F.col("area").cast("string").alias("area"))
    return buses.join(area, "bus", "left").groupBy("contingency").agg(F.sort_array(F.collect_set("area")).alias("areas"))


@query("SELECT event_id, CAST(event_id % 100 + event_id % 7 + event_id % 3 AS BIGINT) AS prompt, CAST(CASE WHEN event_id % 4 = 0 THEN 1000 ELSE event_id % 100 + event_id % 7 + event_id % 3 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 11 END END AS BIGINT) AS total FROM events")
def token_accounting(spark, sf_dir):
    """Token counts of which some are missing; a total that isn't given is the prompt and the output."""
    used = {"input": F.expr("event_id % 100"), "output": F.expr("CASE WHEN event_id % 2 = 1 THEN event_id % 11 END"), "cache_read": F.expr("event_id % 7"), "cache_write": F.expr("event_id % 3"), "total": F.expr("CASE WHEN event_id % 4 = 0 THEN 1000 WHEN event_id % 4 = 1 THEN 0 END")}
    counts = N.tokens(used)
    return spark.table("events").select("event_id", counts["prompt"].alias("prompt"), counts["total"].alias("total"))


@query("""SELECT event_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 1 THEN printf('%.0f ms', s * 1000) WHEN s < 60 THEN printf('%.1f s', s) WHEN round(s) < 3600 THEN concat(CAST(floor(round(s) / 60) AS BIGINT), ' min ', CAST(round(s) % 60 AS BIGINT), ' s')
 ELSE concat(CAST(floor(round(s) / 3600) AS BIGINT), ' h ', CAST(floor(round(s) / 60) % 60 AS BIGINT), ' min') END AS took FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN event_id % 97 / 128.0 WHEN 2 THEN event_id % 500 / 8.0 + 0.01 WHEN 3 THEN event_id + 0.25 ELSE event_id * 10 + 0.25 END AS s FROM events)""")
def durations(spark, sf_dir):
    s = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN event_id % 97 / 128D WHEN 2 THEN event_id % 500 / 8D + 0.01D WHEN 3 THEN event_id + 0.25D ELSE event_id * 10 + 0.25D END")
    return spark.table("events").select("event_id", N.duration(s).alias("took"))


# files


@query("SELECT unnest(['flat', 'flat', 'convergence', 'bus', 'unknown']) AS role, unnest(['cases', 'old_cases', 'events', 'metadata', 'other']) AS folder, unnest([true, false, true, true, false]) AS chosen")
def csv_role_detect(spark, sf_dir):
    """Roles of CSV files by their headers; of two flat results the one in the preferred name is chosen."""
    path = network.shared_path(spark, "roles")
    cases = spark.table("cases")
    made = {"cases": cases.selectExpr("from_bus AS `I Bus`", "to_bus AS `J-Bus`", "line_id AS CKT", "loading_percent AS `Loading (pct)`"), "old_cases": cases.selectExpr("from_bus AS ibus", "to_bus AS jbus", "line_id AS circuit", "loading_percent AS `utilization %pct`"),
        "events": spark.table("convergence").selectExpr("event_idx AS `Event Index`", "contingency AS Event", "converged", "status_code AS status"), "metadata": spark.table("buses").selectExpr("bus_id AS bus", "base_kv AS kv", "area"), "other": spark.table("areas")}
    for name, df in made.items():
        df.write.option("header", True).csv(f"{path}/{name}")  # as many files as it has partitions: a fixed number would grow them with the table
    found = files.csv_roles(spark, path, {"flat": "part-00000"}).select("role", F.element_at(F.split("file", "/"), -2).alias("folder"), "chosen")
    return found.groupBy("role", "folder").agg(F.max("chosen").alias("chosen"))


@query("""SELECT ['csv', 'json', 'txt'][CAST(doc_id % 3 AS INT) + 1] AS suffix, ['table', 'json', 'text'][CAST(doc_id % 3 AS INT) + 1] AS kind, 'supported' AS state,
 CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + CASE doc_id % 3 WHEN 1 THEN 13 ELSE 1 END) AS BIGINT) AS bytes FROM documents GROUP BY ALL""")
def file_inventory(spark, sf_dir):
    """Files by suffix and kind, with their sizes, without reading them."""
    path = network.shared_path(spark, "files")
    for i, kind in enumerate(("csv", "json", "text")):
        spark.table("documents").where(f"doc_id % 3 = {i}").select(F.col("doc_id").cast("string").alias("value")).write.format(kind).save(f"{path}/{kind}")
    return files.inventory(spark, path).groupBy("suffix", "kind", "state").agg(F.sum("bytes").alias("bytes"))


@query("SELECT event_id, p AS path, CASE p WHEN 'e.@id' THEN CAST(event_id AS VARCHAR) WHEN 'e.kind' THEN event_type WHEN 'e.n[1]' THEN CAST(user_id AS VARCHAR) WHEN 'e.n[2]' THEN 'x' ELSE 'y' END AS value FROM events, (SELECT unnest(['e.@id', 'e.kind', 'e.n[1]', 'e.n[2]', 'e.n[2].@unit']) AS p)")
def xml_leaves(spark, sf_dir):
    made = F.expr("concat('<r><e id=\"', event_id, '\"><kind>', event_type, '</kind><n>', user_id, '</n><n unit=\"y\">x</n></e></r>')")
    return documents.xml_leaves(spark.table("events").select("event_id", made.alias("text")), "event_id", "text")


@query(f"SELECT contingency, {_KEYS}, loading_percent, true AS fresh, CAST((SELECT count(*) FROM cases WHERE line_id <> '3') AS BIGINT) AS n_rows FROM cases WHERE event_idx = 9 AND line_id <> '3'")
def event_index_build(spark, sf_dir):
    """The index with its manifest, from CSV in which some loadings aren't numbers; one event read from the latest build."""
    source, path = network.shared_path(spark, "csv"), network.shared_path(spark, "index")
    spark.table("cases").withColumn("loading_percent", F.expr("CASE WHEN line_id = '3' THEN 'inf' ELSE CAST(loading_percent AS STRING) END")).select("event_idx", "contingency", *C.KEY, "loading_percent").write.option("header", True).csv(source)
    row = files.build_index(spark, source, lambda p: files.read_flat(spark, p), path)
    folder, fresh = files.current_index(spark, path, source)
    out = files.read_event(spark, folder, 9).select("contingency", F.col("from_bus").cast("int").alias("from_bus"), F.col("to_bus").cast("int").alias("to_bus"), "line_id", F.coalesce("section", F.lit("")).alias("section"), "loading_percent")
    return out.withColumn("fresh", F.lit(fresh)).withColumn("n_rows", F.lit(row.first().n_rows).cast("long"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT DISTINCT o_orderkey FROM orders)")
def cache_freshness(spark, sf_dir):
    """Cached summaries against their sources: all three tables, of this version, newer than the source."""
    o = spark.table("orders").select("o_orderkey").distinct()
    sources = o.select(F.col("o_orderkey").cast("string").alias("source"), F.lit(100).alias("changed"))
    names = F.explode(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array('branches', 'bad') ELSE array('branches', 'contingencies', 'convergence') END"))
    cached = o.select(F.col("o_orderkey").cast("string").alias("source"), names.alias("name"), F.lit(files.VERSION).alias("version"), F.when((F.col("o_orderkey") % 5 == 0), 90).otherwise(101).alias("written"))
    old = o.select(F.col("o_orderkey").cast("string").alias("source"), F.lit("convergence").alias("name"), F.lit(files.VERSION - 1).alias("version"), F.lit(200).alias("written"))
    return files.cache_state(cached.union(old), sources, ("branches", "contingencies", "convergence"))


# network and order


@query(f"""SELECT p.i, p.j, p.ckt, buses, load_mw, generation_mw, status_code, has_swing FROM (SELECT *, s0 AS has_swing FROM ({_PARTS.replace(' SELECT a.i', ' SELECT a.swing > 0 AS s0, a.i')})) p
 LEFT JOIN (SELECT DISTINCT contingency, status_code FROM convergence) c ON c.contingency IN (concat('BR_', p.i, '_', p.j, '_', p.ckt), concat('BR_', p.j, '_', p.i, '_', p.ckt))""")
def outage_list(spark, sf_dir):
    """Outages that split the network, with the solver's status by the outage's name in either direction."""
    buses, net = _network(spark)
    parts = trees.cut_off(net, buses, trees.splitting(net), swing=True)
    return outages.with_status(parts, spark.table("convergence").select("contingency", "status_code").distinct()).select("i", "j", "ckt", "buses", "load_mw", "generation_mw", "status_code", "has_swing")


@query("SELECT bus, ide, generation_mw + 50 AS generation_mw FROM (SELECT bus, ide, CAST(generation_mw AS DOUBLE) AS generation_mw FROM net_bus) WHERE bus % 5 = 0 AND ide = 1")
def generator_warnings(spark, sf_dir):
    """Generators in service at load buses, after an edit that adds some: they hold their output instead of the voltage."""
    from casewright.operators import edits

    after = spark.table("net_bus").withColumn("generation_mw", F.expr("CASE WHEN bus % 5 = 0 THEN CAST(generation_mw AS DOUBLE) + 50 ELSE CAST(generation_mw AS DOUBLE) END"))
    generators = after.where("generation_mw <> 0").select("bus", "generation_mw", F.lit(1).alias("st"))
    return edits.generator_warnings(generators, after.select("bus", "ide")).select("bus", "ide", "generation_mw")


@query(f"SELECT {_KEYS}, row_number() OVER (ORDER BY first, {_KEYS}) - 1 AS row_index FROM (SELECT {_KEYS}, min(event_idx) AS first FROM cases GROUP BY ALL)")
def row_index(spark, sf_dir):
    """Facilities numbered by first appearance; ranks come from a range partition, not from one task."""
    first = spark.table("cases").groupBy(*C.KEY).agg(F.min("event_idx").alias("first"))
    return ranking.numbered(first, ["first", *C.KEY], "row_index").select(*C.KEY, (F.col("row_index") - 1).alias("row_index"))


@query("SELECT name FROM (SELECT unnest(['base_raw_branch_type', 'base_rate_mva', 'flow_value', 'angle_value']) AS name) WHERE (SELECT count(*) FROM cases) > 0")
def eligible_variables(spark, sf_dir):
    """Grouping variables of the master table that hold a value at all; keys aren't among them."""
    from casewright.plans.wider import _master

    table = _master(spark)
    names = [c for c in table.columns if c not in C.KEY]
    return table.agg(*(F.count(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names))).alias("x")).where("x.n > 0").select("x.name")

