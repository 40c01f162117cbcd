"""The library's front door: scan source files, judge, apply a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import severity_rank
from graphloom.operators import findings as results
from graphloom.operators import properties, rules
from graphloom.schema import FLOWS, NODES, Graph
from graphloom.sources import comments, files, python_graph

# Weaknesses that count in one's own code.
FIRST_PARTY = [f"CWE-{n}" for n in (22, 77, 78, 79, 89, 90, 94, 502, 601, 611, 643, 918, 943)]


def _full(df: DataFrame, schema) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def python_graphs(sources: DataFrame) -> Graph:
    """The graphs of Python files (file, source_code), completed to the engine's schema."""
    nodes, edges, flows = python_graph.tables(sources)
    inputs = flows.withColumn("sensitivity", F.lit("NONE")).withColumn("pos", F.lit(0))
    outputs = inputs.selectExpr("file", "source as node_id", "'out' as direction", "name", "source", "target", "tainted", "sensitivity", "pos")
    full_nodes = _full(nodes.withColumn("language", F.lit("python")), NODES)
    return Graph(full_nodes, edges.withColumn("ord", F.lit(0).cast("long")), _full(inputs, FLOWS).unionByName(_full(outputs, FLOWS)))


def scan(graph: Graph, rule_table: DataFrame | None = None) -> DataFrame:
    """All findings: properties first, then rules of other numbers, deduplicated twice, most severe first.

    Columns: file, ord, cwe, source, sink, missing, severity, collapsed_cwes.
    """
    found = properties.run_all(graph).select("file", "cwe", "source", "sink", "missing", "severity")
    if rule_table is not None:
        more = rules.evaluate(graph, rule_table).select("file", "cwe", "source", "sink", "missing", "severity")
        found = found.unionByName(rules.covered_removed(more, found))
    found = found.distinct().withColumn("ord", F.xxhash64("file", "cwe", "source", "sink", "missing"))
    return results.family_dedup(results.dedup(found.select("file", "ord", "cwe", "source", "sink", "missing", "severity"))).orderBy(severity_rank(F.col("severity")).desc(), "ord")


def scan_directory(spark, folder: str, rule_table: DataFrame | None = None) -> DataFrame:
    """Scan the Python files below a folder."""
    return scan(python_graphs(files.scan_directory(spark, folder).where("language = 'python'")), rule_table)


def has_security_issues(graph: Graph) -> bool:
    return not properties.run_all(graph).isEmpty()


def apply_policy(found: DataFrame, intentional: DataFrame | None = None, mode: str = "all") -> DataFrame:
    """Drop findings at sinks that are meant to be there, and in mode 'first_party' all but the own code's weaknesses.

    intentional: (file_prefix, sink_pattern).
    """
    if mode == "first_party":
        found = found.where(F.col("cwe").isin(*FIRST_PARTY))
    if intentional is None:
        return found
    meant = F.expr("startswith(file, file_prefix) and sink rlike sink_pattern")
    return found.join(F.broadcast(intentional), meant, "left_anti")


def origin_violations(graph: Graph, origins: DataFrame) -> DataFrame:
    """(file, id, field): writes of a field (origins: field) that no read of it precedes in the file."""
    at = graph.nodes.where("node_type = 'STORAGE'").select("file", "id", "sequence", "node_subtype", "code_snapshot")
    uses = at.join(F.broadcast(origins), F.expr("contains(code_snapshot, field)"))
    first_read = uses.where("node_subtype = 'db_read'").groupBy("file", "field").agg(F.min("sequence").alias("read_at"))
    writes = uses.where("node_subtype = 'db_write'").join(first_read, ["file", "field"], "left")
    return writes.where("read_at is null or read_at >= sequence").select("file", "id", "field")


def without_comments(sources: DataFrame) -> DataFrame:
    return comments.without_comments(sources)
