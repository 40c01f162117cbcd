"""Building and completing a graph: flow upserts, derived edges, initial taint, sentence text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import neutralized_bits, sensitivity
from graphloom.schema import Graph

READ_SUBTYPES = ("db_read", "cache_read", "state_read")
WRITE_SUBTYPES = ("db_write", "cache_write", "state_write")


def upsert_flows(flows: DataFrame) -> DataFrame:
    """One flow per (file, node, direction, name, source, target): taint is OR-ed, the first range stays."""
    keys = ["file", "node_id", "direction", "name", "source", "target"]
    return flows.groupBy(*keys).agg(
        F.min("pos").alias("pos"), F.min_by("data_type", "pos").alias("data_type"), F.bool_or("tainted").alias("tainted"), F.min_by("sensitivity", "pos").alias("sensitivity"),
        F.min_by("range", F.when(F.col("range").isNotNull(), F.col("pos"))).alias("range"), F.min_by("write_size", F.when(F.col("write_size").isNotNull(), F.col("pos"))).alias("write_size"),
    )


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (file, src, dst, type)."""
    return edges.groupBy("file", "src", "dst", "edge_type").agg(F.min("ord").alias("ord"))


def data_flow_edges(graph: Graph) -> DataFrame:
    """DATA_FLOW from every known source of an input to its node."""
    ids = graph.nodes.select("file", F.col("id").alias("source")).distinct()
    found = graph.inputs().where("source is not null and source <> 'EXTERNAL'").join(ids, ["file", "source"], "left_semi")
    return found.select("file", F.col("source").alias("src"), F.col("node_id").alias("dst"), F.lit("DATA_FLOW").alias("edge_type")).distinct()


def storage_edges(graph: Graph) -> DataFrame:
    """READS from storage that is read to its consumers, WRITES from producers to storage that is written."""
    stores = graph.nodes.where("node_type = 'STORAGE'").select("file", "id", "node_subtype")
    flows = graph.inputs().where("source is not null and source <> 'EXTERNAL'").select("file", "source", "node_id").distinct()
    reads = stores.where(F.col("node_subtype").isin(*READ_SUBTYPES)).join(flows.withColumnRenamed("source", "id"), ["file", "id"])
    writes = stores.where(F.col("node_subtype").isin(*WRITE_SUBTYPES)).join(flows.withColumnRenamed("node_id", "id"), ["file", "id"])
    return reads.select("file", F.col("id").alias("src"), F.col("node_id").alias("dst"), F.lit("READS").alias("edge_type")).union(writes.select("file", F.col("source"), F.col("id"), F.lit("WRITES")))


def depends_edges(graph: Graph) -> DataFrame:
    """DEPENDS from a file's module node to each of its dependencies."""
    return graph.nodes.where("node_subtype in ('dependency', 'import')").select("file", F.concat(F.lit("module_"), "file").alias("src"), F.col("id").alias("dst"), F.lit("DEPENDS").alias("edge_type"))


def initial_taint(graph: Graph) -> DataFrame:
    """The flows with first taint: INGRESS and EXTERNAL outputs are tainted, outputs of sanitize* and encrypt are not; names set sensitivity.

    Adds security_state, eleven bits, where the node decides it; null elsewhere.
    """
    nodes = graph.nodes.select("file", F.col("id").alias("node_id"), "node_type", "node_subtype")
    sub = F.col("node_subtype")
    cleans = (F.col("node_type") == "TRANSFORM") & (sub.rlike("^sanitize(_|$)") | (sub == "encrypt"))
    out, foreign = F.col("direction") == "out", F.col("node_type").isin("INGRESS", "EXTERNAL")
    found = sensitivity(F.col("name"))
    return graph.flows.join(nodes, ["file", "node_id"], "left").select(
        *[c for c in graph.flows.columns if c not in ("tainted", "sensitivity")],
        F.when(out & foreign, True).when(out & cleans, False).otherwise(F.col("tainted")).alias("tainted"),
        F.when(found != "NONE", found).otherwise(F.col("sensitivity")).alias("sensitivity"),
        F.when(out & foreign, 0).when(out & cleans, neutralized_bits(sub)).cast("int").alias("security_state"),
    )


# Sentence templates by key.
TEMPLATES = {
    "retrieves-from-source": "{subject} receives {data_type} from {source}, {context}",
    "retrieves-from-collection": "{subject} retrieves value at key {key} from {collection}, {context}",
    "assigned-from-call": "{subject} assigned from {object}.{method}({args}), {context}",
    "assigned-literal": "{subject} assigned literal value {value}, {context}",
    "executes-query": "{subject} executes {query_type} query containing {variables}, {context}",
    "calls-method": "{subject} calls {method} on {object} with {args}, {context}",
    "string-concatenation": "{subject} built by concatenating {parts}, {context}",
    "parameter-binding": "{subject} binds {variable} at position {index}, {context}",
    "returns-value": "{subject} returns {value}, {context}",
    "gate-conditional": "IF {condition} THEN following block executes, gate type: {gate_type}",
    "iterates-over": "{subject} iterates over {collection}, {context}",
    "creates-instance": "{subject} creates new {class} with {args}, {context}",
    "writes-response": "{subject} writes {args} to client response containing {variables}, {context}",
    "accesses-path": "{subject} accesses filesystem path containing {variables}, {context}",
    "executes-command": "{subject} executes OS command containing {variables}, {context}",
}
# Template of a node by type and subtype where it isn't 'calls-method'.
TEMPLATE_OF = {
    ("STORAGE", "db_read"): "executes-query", ("STORAGE", "db_write"): "executes-query", ("STORAGE", "db_stored_proc"): "executes-query", ("STORAGE", "sql_query"): "executes-query", ("STORAGE", "file_read"): "accesses-path", ("STORAGE", "file_write"): "accesses-path",
    ("TRANSFORM", "string_concat"): "string-concatenation", ("CONTROL", "loop"): "iterates-over", ("CONTROL", None): "gate-conditional", ("EXTERNAL", "system_exec"): "executes-command",
    ("EGRESS", "http_response"): "writes-response", ("EGRESS", "redirect"): "writes-response", ("EGRESS", "file_write"): "accesses-path", ("EGRESS", "file_serve"): "accesses-path", ("INGRESS", None): "retrieves-from-source",
}


def template_key(node_type: Column, subtype: Column) -> Column:
    exact = [((node_type == t) & (subtype == s), key) for (t, s), key in TEMPLATE_OF.items() if s is not None]
    general = [(node_type == t, key) for (t, s), key in TEMPLATE_OF.items() if s is None]
    return reduce(lambda acc, c: acc.when(c[0], c[1]), (exact + general)[1:], F.when(exact[0][0], exact[0][1])).otherwise("calls-method")


def fill(key: Column, slots: Column) -> Column:
    """The template's text with its slots filled; slots that are missing stay as they are."""
    text = F.element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), key)
    return F.aggregate(F.map_entries(slots), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def resolve_pending(sentences: DataFrame, functions: DataFrame) -> DataFrame:
    """Pending sentences (sid, method, taint_class, taint_basis) take the class of the called function's return.

    functions: (name, ord, return_taint BOOLEAN NULL). The first function named counts; unknown returns leave the sentence.
    """
    named = functions.groupBy(F.col("name").alias("method")).agg(F.min_by("return_taint", "ord").alias("return_taint"))
    joined = sentences.join(named, "method", "left")
    pending = F.col("taint_basis") == "PENDING"
    new = F.when(pending & ~F.col("return_taint"), "NEUTRAL").when(pending & F.col("return_taint"), "TAINTED").otherwise(F.col("taint_class"))
    return joined.select(*[c for c in sentences.columns if c != "taint_class"], new.alias("taint_class"), F.coalesce(pending & (new != F.col("taint_class")), F.lit(False)).alias("reconciled"))
