"""The driver's tables as graphs, with SQL twins for DuckDB.

G-events: a user's session (events at most six hours apart) is a file, an event
a node; edges lead to the next event, and to the next one of the same type; a
function node contains the session. G-star: customer, order, part, supplier,
nation and region are nodes of one file, keys are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import RANGE, Graph

GAP_HOURS = 6
TYPE_OF_EVENT = {"signup": "INGRESS", "view": "TRANSFORM", "click": "CONTROL", "error": "AUTH", "purchase": "STORAGE"}
SUBTYPES = """CASE event_type
  WHEN 'signup' THEN 'http_request'
  WHEN 'view' THEN CASE WHEN value > 40 THEN 'encrypt' WHEN value > 25 THEN 'sanitize_html' WHEN value > 12 THEN 'parse' ELSE 'hash' END
  WHEN 'click' THEN CASE WHEN value > 20 THEN 'validation' ELSE 'branch' END
  WHEN 'error' THEN 'auth_check'
  ELSE CASE WHEN value > 40 THEN 'db_write' WHEN value > 20 THEN 'file_write' WHEN value > 8 THEN 'log_write' ELSE 'sql_query' END END"""
CODE = """CASE event_type WHEN 'view' THEN CASE WHEN value > 30 THEN 'md5(' WHEN value > 15 THEN 'sha256(' ELSE 'x + ' END
  WHEN 'click' THEN CASE WHEN value > 30 THEN 'if (role == admin) check(/[a-z]+/)' WHEN value > 10 THEN 'if (amount == 25)' ELSE 'if (true)' END
  WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'close(' ELSE 'INSERT INTO orders ' END ELSE 'call(' END"""

#: One text for both engines; {events} is the table, {hours} the interval's spelling.
EVENT_ROWS = f"""
SELECT event_id, user_id, event_type, value, ts, 's' || CAST(user_id AS {{string}}) || '_' || CAST(sum(fresh) OVER w AS {{string}}) AS file
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {GAP_HOURS} HOUR THEN 0 ELSE 1 END AS fresh FROM {{events}}) f
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
EVENT_NODES = f"""
SELECT file, 'e' || CAST(event_id AS {{string}}) AS id, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS sequence, event_type AS label,
  CASE event_type WHEN 'signup' THEN 'INGRESS' WHEN 'view' THEN 'TRANSFORM' WHEN 'click' THEN 'CONTROL' WHEN 'error' THEN 'AUTH' ELSE 'STORAGE' END AS node_type,
  {SUBTYPES} AS node_subtype, {CODE} AS code_snapshot, value,
  lag('e' || CAST(event_id AS {{string}})) OVER (PARTITION BY file ORDER BY ts, event_id) AS prev, lag(event_type) OVER (PARTITION BY file ORDER BY ts, event_id) AS prev_type,
  lag(value) OVER (PARTITION BY file ORDER BY ts, event_id) AS prev_value,
  lead('e' || CAST(event_id AS {{string}})) OVER (PARTITION BY file ORDER BY ts, event_id) AS next,
  lead('e' || CAST(event_id AS {{string}})) OVER (PARTITION BY file, event_type ORDER BY ts, event_id) AS next_same
FROM ev"""

TAINT, SECRET = 20.0, 60.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(EVENT_ROWS.format(events="{e}", string="string"), e=events)
    return spark.sql(EVENT_NODES.format(string="string").replace("FROM ev", "FROM {ev}"), ev=rows)


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    n = _events(spark, sf_dir)
    none = F.lit(None)
    fit = F.struct(none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("boolean").alias("bounded"), none.cast("string").alias("source_node_id")).cast(RANGE)
    room = F.when(F.col("node_type") == "STORAGE", F.struct(F.col("value").alias("min"), F.col("value").alias("max"), F.lit(True).alias("bounded"), none.cast("string").alias("source_node_id")))
    own = n.select(
        "file", "id", "sequence", "label", "node_type", "node_subtype", F.lit("javascript").alias("language"), F.col("sequence").alias("line_start"), F.col("sequence").alias("line_end"),
        "code_snapshot", F.lit("").alias("analysis_snapshot"), none.cast("string").alias("algorithm_name"), F.array("label").alias("callee_chain"),
        F.when(F.col("value") > SECRET, F.array(F.lit("admin_write"))).otherwise(F.array().cast("array<string>")).alias("attack_surface"), F.lit("").alias("trust_boundary"),
        F.array().cast("array<string>").alias("tags"), room.cast(RANGE).alias("buffer_size"),
    )
    holder = n.groupBy("file").agg(F.max("sequence").alias("last")).select(
        "file", F.concat(F.lit("f_"), "file").alias("id"), F.lit(0).cast("long").alias("sequence"), F.lit("session").alias("label"), F.lit("STRUCTURAL").alias("node_type"), F.lit("function").alias("node_subtype"),
        F.lit("javascript").alias("language"), F.lit(0).cast("long").alias("line_start"), F.col("last").cast("long").alias("line_end"), F.lit("function session()").alias("code_snapshot"), F.lit("").alias("analysis_snapshot"),
        none.cast("string").alias("algorithm_name"), F.array().cast("array<string>").alias("callee_chain"), F.array().cast("array<string>").alias("attack_surface"), F.lit("").alias("trust_boundary"), F.array().cast("array<string>").alias("tags"), fit.alias("buffer_size"),
    )
    edges = (
        n.where("next is not null").select("file", F.col("id").alias("src"), F.col("next").alias("dst"), F.lit("DATA_FLOW").alias("edge_type"), F.lit(0).cast("long").alias("ord"))
        .union(n.where("next_same is not null").select("file", F.col("id"), F.col("next_same"), F.lit("CALLS"), F.lit(1).cast("long")))
        .union(n.select("file", F.concat(F.lit("f_"), "file"), F.col("id"), F.lit("CONTAINS"), F.col("sequence").cast("long")))
    )

    def level(v):
        return F.when(F.col(v) > 100, "FINANCIAL").when(F.col(v) > SECRET, "AUTH").when(F.col(v) > 50, "PII").otherwise("NONE")

    def flow(direction, name, source, target, value):
        r = F.when(F.col(value) > 10, F.struct(F.lit(0.0).alias("min"), F.col(value).alias("max"), F.lit(True).alias("bounded"), none.cast("string").alias("source_node_id")))
        size = F.struct(F.lit(0.0).alias("min"), F.col(value).alias("max"), F.lit(True).alias("bounded"), none.cast("string").alias("source_node_id"))
        return [F.col("file"), F.col("id").alias("node_id"), F.lit(direction).alias("direction"), F.lit(0).cast("long").alias("pos"), name.alias("name"), source.alias("source"), target.alias("target"),
                F.when(F.col(value) < 2, "literal").otherwise("number").alias("data_type"), (F.col(value) > TAINT).alias("tainted"), level(value).alias("sensitivity"), r.cast(RANGE).alias("range"), size.cast(RANGE).alias("write_size")]

    amount = F.lit("amount")
    flows = n.where("prev is not null").select(*flow("in", amount, F.col("prev"), F.col("id"), "prev_value")).union(n.select(*flow("out", amount, F.col("id"), F.col("next"), "value")))
    return Graph(own.unionByName(holder), edges, flows)


EVENTS_SQL = f"""ev AS ({EVENT_ROWS.format(events="events", string="VARCHAR")}), n AS ({EVENT_NODES.format(string="VARCHAR")}),
nodes AS (SELECT file, id, sequence, label, node_type, node_subtype, code_snapshot, value FROM n
  UNION ALL SELECT file, 'f_' || file, 0, 'session', 'STRUCTURAL', 'function', 'function session()', NULL FROM n GROUP BY file),
edges AS (SELECT file, id AS src, next AS dst, 'DATA_FLOW' AS edge_type, 0 AS ord FROM n WHERE next IS NOT NULL
  UNION ALL SELECT file, id, next_same, 'CALLS', 1 FROM n WHERE next_same IS NOT NULL
  UNION ALL SELECT file, 'f_' || file, id, 'CONTAINS', sequence FROM n),
flows AS (SELECT file, id AS node_id, 'in' AS direction, 'amount' AS name, prev AS source, id AS target, prev_value AS v FROM n WHERE prev IS NOT NULL
  UNION ALL SELECT file, id, 'out', 'amount', id, next, value FROM n),
fl AS (SELECT *, v > {TAINT} AS tainted, CASE WHEN v > 100 THEN 'FINANCIAL' WHEN v > {SECRET} THEN 'AUTH' WHEN v > 50 THEN 'PII' ELSE 'NONE' END AS sensitivity FROM flows),
fe AS (SELECT DISTINCT file, src, dst FROM edges WHERE edge_type <> 'CONTAINS'),
loaded AS (SELECT DISTINCT file, node_id AS node FROM fl WHERE direction = 'in' AND (tainted OR sensitivity <> 'NONE'))"""


def star_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of G-star: nodes have file, id, sequence, node_type, tainted."""
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "orders", "lineitem", "supplier", "nation", "part")}
    file = F.lit("star").alias("file")

    def node(df, prefix, key, kind, tainted=None):
        return df.select(file, F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(key).cast("long").alias("sequence"), kind.alias("node_type"), F.coalesce(tainted if tainted is not None else F.lit(False), F.lit(False)).alias("tainted"))

    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "CONTROL").otherwise("TRANSFORM")
    nodes = node(t["customer"], "c", "c_custkey", F.lit("INGRESS"), F.col("c_acctbal") < 500).unionByName(node(t["orders"], "o", "o_orderkey", urgent)).unionByName(node(t["part"], "p", "p_partkey", F.lit("STORAGE"))).unionByName(node(t["supplier"], "s", "s_suppkey", F.lit("EXTERNAL"))).unionByName(node(t["nation"], "n", "n_nationkey", F.lit("STRUCTURAL")))

    def edge(df, a, ka, b, kb, kind):
        return df.select(file, F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("edge_type")).distinct()

    edges = edge(t["orders"], "c", "o_custkey", "o", "o_orderkey", "DATA_FLOW").unionByName(edge(t["lineitem"], "o", "l_orderkey", "p", "l_partkey", "WRITES")).unionByName(edge(t["lineitem"], "p", "l_partkey", "s", "l_suppkey", "CALLS"))
    edges = edges.unionByName(edge(t["nation"], "r", "n_regionkey", "n", "n_nationkey", "CONTAINS")).unionByName(edge(t["supplier"], "n", "s_nationkey", "s", "s_suppkey", "CONTAINS"))
    return nodes, edges


STAR_SQL = """sn AS (SELECT 'c' || c_custkey AS id, c_custkey AS sequence, 'INGRESS' AS node_type, coalesce(c_acctbal < 500, false) AS tainted FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'CONTROL' ELSE 'TRANSFORM' END, false FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_partkey, 'STORAGE', false FROM part UNION ALL SELECT 's' || s_suppkey, s_suppkey, 'EXTERNAL', false FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 'STRUCTURAL', false FROM nation),
se AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'DATA_FLOW' AS edge_type FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'WRITES' FROM lineitem UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'CALLS' FROM lineitem
  UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS' FROM nation UNION ALL SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey, 'CONTAINS' FROM supplier)"""
