"""Scope joins: shared parents, line spans, nearest node, smallest enclosing span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.reach import FUNCTION_SUBTYPES, per_group_first
from graphloom.schema import Graph


def same_scope(graph: Graph, left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, a, b): nodes of left and right (file, id) that share a CONTAINS parent or a function's line span."""
    parent = graph.edges.where("edge_type = 'CONTAINS'").select("file", F.col("src").alias("scope"), F.col("dst").alias("id")).distinct()
    functions = graph.nodes.where((F.col("node_type") == "STRUCTURAL") & F.col("node_subtype").isin(*FUNCTION_SUBTYPES)).select("file", F.col("id").alias("scope"), F.col("line_start").alias("lo"), F.col("line_end").alias("hi"))
    lines = graph.nodes.select("file", "id", "line_start")
    spanned = functions.join(lines, "file").where("line_start between lo and hi and id <> scope").select("file", "scope", "id")
    scopes = parent.union(spanned).distinct()
    a = left.select("file", "id").join(scopes, ["file", "id"]).withColumnRenamed("id", "a")
    b = right.select("file", "id").join(scopes, ["file", "id"]).withColumnRenamed("id", "b")
    return a.join(b, ["file", "scope"]).where("a <> b").select("file", "a", "b").distinct()


def smallest_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, point, span): the shortest span (file, span, lo, hi) around each point (file, point, line); ties by name."""
    around = points.join(spans, "file").where("line between lo and hi")
    return around.groupBy("file", "point").agg(F.min_by("span", F.struct(F.col("hi") - F.col("lo"), "span")).alias("span"))


def nearest_node(lines: DataFrame, nodes: DataFrame, reach: int = 2) -> DataFrame:
    """(file, line, id): the node on a line, else one at most ``reach`` lines off, else the file's first."""
    close = lines.join(nodes.select("file", "id", "line_start", "sequence"), "file")
    off = F.abs(F.col("line_start") - F.col("line"))
    rank = F.when(off == 0, 0).when(off <= reach, 1).otherwise(2)
    return per_group_first(close.withColumn("rank", rank), ["file", "line"], ["rank", "sequence"]).select("file", "line", "id")


def scope_taint(graph: Graph, sources: DataFrame, sinks: DataFrame, neutral: DataFrame) -> DataFrame:
    """(file, a, b): source and sink share a scope with a tainted transform and no neutralising one."""
    pairs = same_scope(graph, sources, sinks)
    tainted = graph.outputs().where("tainted").select("file", F.col("node_id").alias("id")).distinct()
    transforms = graph.nodes.where("node_type = 'TRANSFORM'").select("file", "id").join(tainted, ["file", "id"], "left_semi")
    carried = same_scope(graph, sinks, transforms).select("file", F.col("a").alias("b")).distinct()
    washed = same_scope(graph, sinks, neutral).select("file", F.col("a").alias("b")).distinct()
    return pairs.join(carried, ["file", "b"], "left_semi").join(washed, ["file", "b"], "left_anti").select("file", "a", "b")


def line_windows(lines: DataFrame, before: int, after: int) -> DataFrame:
    """(file, line, text, around): each line with its neighbours' text."""
    w = f"partition by file order by line rows between {int(before)} preceding and {int(after)} following"
    return lines.withColumn("around", F.expr(f"array_join(collect_list(text) over ({w}), '\n')"))


def near_lines(left: DataFrame, right: DataFrame, key: str, span: int) -> DataFrame:
    """Rows of right (file, line, key) at most ``span`` lines behind a row of left with the same key."""
    r = right.select("file", key, F.col("line").alias("right_line"))
    return left.join(r, ["file", key]).where(F.col("right_line").between(F.col("line"), F.col("line") + span))
