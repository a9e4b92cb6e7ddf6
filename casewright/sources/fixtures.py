"""Views over the given tables that stand for case data; the same SQL text runs on Spark and in oracle queries."""

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

VIEWS = {
    "buses": """SELECT n_nationkey AS bus_id, n_name AS bus_name,
  CAST(CASE n_nationkey % 7 WHEN 0 THEN 13.8 WHEN 1 THEN 69 WHEN 2 THEN 115 WHEN 3 THEN 138
       WHEN 4 THEN 230 WHEN 5 THEN 345 ELSE 500 END AS DOUBLE) AS base_kv,
  n_regionkey AS area, n_regionkey + 10 AS zone
FROM nation""",
    "areas": """SELECT r_regionkey AS area, r_name AS area_name FROM region""",
    "cases": """SELECT CAST(l_orderkey % 64 AS INT) AS event_idx,
  CASE WHEN l_orderkey % 64 = 0 THEN 'base_case'
       WHEN l_orderkey % 4 = 1 THEN CONCAT('GN_', CAST((l_orderkey % 64) % 25 AS STRING), '_1')
       ELSE CONCAT('BR_', CAST((l_orderkey % 64) % 25 AS STRING), '_', CAST(((l_orderkey % 64) * 7 + 3) % 25 AS STRING), '_1')
  END AS contingency,
  s_nationkey AS from_bus, c_nationkey AS to_bus, CAST(l_linenumber AS STRING) AS line_id, '' AS section,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 100 + 10 * l_linenumber END AS DOUBLE) AS rate_mva,
  (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice / 1000 AS loading_percent,
  CASE WHEN l_linestatus = 'F' AND l_quantity >= 49 THEN 1 ELSE 0 END AS viol,
  l_extendedprice / 2000 - 20 AS p_from_mw,
  CAST(0.9 AS DOUBLE) + l_tax * 2 AS v_from_pu,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(1 AS DOUBLE) - l_discount END AS v_to_pu,
  l_quantity - 25 AS ang_from_deg, CAST(l_partkey % 40 - 20 AS DOUBLE) AS ang_to_deg
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey""",
    "cases_b": """SELECT event_idx, contingency, from_bus, to_bus, line_id, section,
  CASE WHEN line_id = '2' THEN rate_mva + 50 ELSE rate_mva END AS rate_mva,
  loading_percent + (from_bus - 12) AS loading_percent
FROM cases WHERE NOT (from_bus = 3 AND to_bus = 4)""",
    "convergence": """SELECT DISTINCT event_idx, contingency,
  CASE WHEN contingency LIKE 'GN%' THEN 'generator' ELSE 'branch' END AS type,
  CASE WHEN event_idx % 16 = 9 THEN 'false' ELSE 'true' END AS converged,
  CASE WHEN event_idx % 16 = 9 THEN 'DIVERGED' WHEN event_idx % 16 = 5 THEN 'ISLANDED'
       WHEN event_idx = 62 THEN 'SLACK_OVERLOAD' ELSE 'OK' END AS status_code,
  2 + event_idx % 5 AS iterations
FROM cases WHERE event_idx <> 0""",
    "branch_metadata": """SELECT DISTINCT from_bus, to_bus, line_id, section, rate_mva,
  CASE line_id WHEN '4' THEN 'two_winding_transformer_branch' WHEN '5' THEN 'three_winding_transformer_branch'
       ELSE 'nontransformer_branch' END AS raw_branch_type
FROM cases""",
    "net_bus": """SELECT s_suppkey AS bus, s_name AS bus_name, s_nationkey AS area,
  CASE WHEN s_suppkey = 0 THEN 3 WHEN s_suppkey % 29 = 28 THEN 4 WHEN s_suppkey % 6 = 1 THEN 2 ELSE 1 END AS ide,
  s_acctbal AS load_mw, CASE WHEN s_suppkey % 6 = 1 THEN s_acctbal * 2 ELSE 0 END AS generation_mw
FROM supplier""",
    "net_element": """SELECT * FROM (
  SELECT s_suppkey AS i, CAST(FLOOR(s_suppkey / 2) AS BIGINT) AS j, '1' AS ckt,
    CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 1 END AS st FROM supplier WHERE s_suppkey >= 1
  UNION ALL
  SELECT s_suppkey, s_suppkey + 3, '1', 1 FROM supplier
    WHERE s_suppkey % 5 = 0 AND s_suppkey + 3 <= (SELECT MAX(s_suppkey) FROM supplier)
  UNION ALL
  SELECT s_suppkey, CAST(FLOOR(s_suppkey / 2) AS BIGINT), '2', 1 FROM supplier WHERE s_suppkey >= 1 AND s_suppkey % 7 = 0) e""",
    "solver_lines": """SELECT user_id AS run_id, event_id AS line_no, ts,
  CASE event_type WHEN 'signup' THEN CONCAT('Total contingencies to analyze: ', CAST(event_id % 100 + 1 AS STRING))
    WHEN 'click' THEN CONCAT('contingency: ', CAST(event_id AS STRING), ' success: true')
    WHEN 'view' THEN 'Controller iteration = 1' WHEN 'purchase' THEN 'Power flow converged'
    ELSE 'Writing output files' END AS line
FROM events""",
    "audit": """SELECT user_id AS session, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'user' WHEN 'purchase' THEN 'assistant' ELSE 'call' END AS kind,
  event_type AS tool, value AS seconds
FROM events""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views for the tables and everything derived from them."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def with_views(sql: str) -> str:
    """sql with the views as common table expressions in front."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in VIEWS.items()) + "\n" + sql
