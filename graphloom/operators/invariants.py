"""Twelve checks of a graph's shape, and the verdict on its health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import Graph

CONTAINERS = ("function", "class", "method", "route", "module")
LEAF_CONTROLS = ("return", "break", "continue", "throw", "assert")
LEAF_TRANSFORMS = ("assignment",)
COLLECTIONS = r"(List|Set|Map|Queue|Stack|Collection|Array|Vector|Deque)$|(?i)^(values|entries|elements|keys|names|params|args|headers|cookies|parts|items|results|records|rows|columns|fields|buffer|temp|output)$"


def violations(graph: Graph) -> DataFrame:
    """(code, severity, file, id) of every broken invariant."""
    nodes, edges, flows = graph.nodes, graph.edges, graph.flows
    ids = nodes.select("file", "id").distinct()

    def named(df: DataFrame, code: str, severity: str, id_: str | Column = "id") -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "file", (F.col(id_) if isinstance(id_, str) else id_).alias("id"))

    def ends(col: str) -> DataFrame:
        return edges.select("file", F.col(col).alias("id")).distinct()

    busy = flows.select("file", F.col("node_id").alias("id")).distinct()
    outputs = graph.outputs().select("file", F.col("node_id").alias("id")).distinct()
    types = nodes.select("file", F.col("id").alias("src"), F.col("node_type").alias("t"), F.col("node_subtype").alias("s"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    known = edges.join(ids.withColumnRenamed("id", "dst"), ["file", "dst"], "left_semi")
    arrivals = graph.inputs().select("file", F.col("source").alias("src"), F.col("node_id").alias("dst")).distinct()
    contains = edges.where("edge_type = 'CONTAINS'").select("file", F.col("src").alias("id"), "dst").distinct()
    containers = nodes.where("node_type = 'STRUCTURAL'").where(F.col("node_subtype").isin(*CONTAINERS))
    leaf = ((F.col("node_type") == "CONTROL") & F.col("node_subtype").isin(*LEAF_CONTROLS)) | ((F.col("node_type") == "TRANSFORM") & F.col("node_subtype").isin(*LEAF_TRANSFORMS))
    receiver = F.regexp_extract("label", r"^(?:[\w.]*\.)?(\w+)\.\w+\(", 1)
    given = graph.outputs().select("file", F.col("node_id").alias("source"), "name", F.col("target").alias("t")).distinct()
    taken = graph.inputs().where("source is not null and source <> 'EXTERNAL'").select("file", F.col("node_id").alias("id"), "source", "name").distinct()
    taken = taken.join(ids.withColumnRenamed("id", "source"), ["file", "source"], "left_semi")
    matched = taken.join(given, ["file", "source", "name"]).where("t is null or t = id").select("file", "id", "source", "name")
    with_flow = contains.join(busy.withColumnRenamed("id", "dst"), ["file", "dst"], "left_semi").select("file", "id").distinct()
    parts = [
        named(nodes.groupBy("file", "id").count().where("count > 1"), "UNIQUE_IDS", "error"),
        named(edges.join(ids.withColumnRenamed("id", "dst"), ["file", "dst"], "left_anti"), "EDGE_TARGET_EXISTS", "error", "src"),
        named(known.where("edge_type = 'DATA_FLOW'").join(arrivals, ["file", "src", "dst"], "left_anti"), "DATA_FLOW_CONSISTENCY", "warning", "src"),
        named(nodes.where(((F.col("node_type") == "INGRESS") & F.array_contains(tags, "control")) | ((F.col("node_type") == "CONTROL") & F.array_contains(tags, "ingress"))), "TYPE_CONFLICT", "warning"),
        named(nodes.where((F.col("node_type") == "CONTROL") & (F.trim(F.coalesce("code_snapshot", F.lit(""))) == "")), "CONTROL_SNAPSHOT_EMPTY", "warning"),
        named(containers.join(contains, ["file", "id"], "left_anti"), "STRUCTURAL_MISSING_CONTAINS", "warning"),
        named(nodes.where("node_type not in ('STRUCTURAL', 'META')").where(~leaf).join(ends("src"), ["file", "id"], "left_anti").join(ends("dst"), ["file", "id"], "left_anti").join(busy, ["file", "id"], "left_anti"), "ORPHAN_NODE", "warning"),
        named(edges.groupBy("file", "src", "dst", "edge_type").count().where("count > 1"), "DUPLICATE_EDGE", "warning", "src"),
        named(taken.join(matched, ["file", "id", "source", "name"], "left_anti"), "DATA_FLOW_ASYMMETRY", "warning"),
        named(nodes.where("node_type = 'INGRESS'").join(outputs, ["file", "id"], "left_anti").join(ends("src"), ["file", "id"], "left_anti"), "INGRESS_NO_OUTPUT", "warning"),
        named(containers.join(contains, ["file", "id"], "left_semi").join(with_flow, ["file", "id"], "left_anti"), "CONTAINER_NO_DATA_FLOW", "info"),
        named(nodes.where("node_type = 'STORAGE'").where((receiver != "") & receiver.rlike(COLLECTIONS)), "STORAGE_COLLECTION_MISCLASS", "error"),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    """One row: counts by severity and a verdict."""
    counts = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])
    return counts.withColumn("verdict", F.when(F.col("error") > 0, "BROKEN").when(F.col("warning") > 0, "DEGRADED").otherwise("HEALTHY"))
