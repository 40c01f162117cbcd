"""Certificates as analytics: class of the sink, path analysis, what blocks it, strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import reach
from graphloom.operators.lookup import transform_effect
from graphloom.schema import Graph

# Class of a sink by its subtype, then by words in it; and of a weakness.
CLASS_OF_SUBTYPE = {"sql": ["sql_query", "db_read", "db_write", "db_stored_proc"], "command": ["system_exec", "shell_exec", "process_spawn"], "xss": ["http_response", "html_render", "template_render"], "path": ["file_read", "file_write", "file_access"], "ldap": ["ldap_query", "ldap_search"], "xpath": ["xpath_query"], "xxe": ["xml_parse"], "ssrf": ["http_request", "url_fetch"], "redirect": ["redirect"], "deserialize": ["deserialize"], "log": ["log_write"]}
CLASS_OF_CWE = {"sql": [89, 564, 943], "command": [77, 78, 88], "xss": [79, 80], "path": [22, 23, 36, 73], "ldap": [90], "xpath": [643], "xxe": [611], "ssrf": [918], "redirect": [601], "deserialize": [502], "log": [117]}


def class_of_sink(subtype: Column) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for name, subs in CLASS_OF_SUBTYPE.items():
        case = case.when(subtype.isin(*subs), name)
    for name, word in (("sql", "sql"), ("command", "exec"), ("path", "file"), ("xss", "html"), ("log", "log")):
        case = case.when(subtype.contains(word), name)
    return case


def class_of_cwe(cwe: Column) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for name, numbers in CLASS_OF_CWE.items():
        case = case.when(cwe.isin(*[f"CWE-{n}" for n in numbers]), name)
    return case


def certify(graph: Graph, findings: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """findings (file, cwe, source, sink) with class, hops, blocked and strength.

    The class comes from the sink's subtype, then the weakness, then the sinks that functions of the file are known to
    feed (contexts: file, subtype). Along the first shortest path a transform that destroys a value blocks. An open
    path is conclusive, a pair without one (text evidence) indicative, a path with effects that aren't known strong.
    """
    sinks = graph.nodes.select("file", F.col("id").alias("sink"), F.col("node_subtype").alias("sink_subtype"))
    named = findings.join(sinks, ["file", "sink"], "left")
    found = F.coalesce(class_of_sink(F.col("sink_subtype")), class_of_cwe(F.col("cwe")))
    if contexts is not None:
        near = contexts.groupBy("file").agg(F.min("subtype").alias("fed"))
        named = named.join(near, "file", "left")
        found = F.coalesce(found, class_of_sink(F.col("fed")))
    named = named.withColumn("class", found).where("class is not null")
    paths = reach.shortest_paths(graph, graph.nodes.join(findings.select("file", F.col("source").alias("id")).distinct(), ["file", "id"], "left_semi"))
    paths = paths.select("file", F.col("seed").alias("source"), F.col("node").alias("sink"), "path")
    placed = named.join(paths, ["file", "source", "sink"], "left").select(*findings.columns, "class", "path")
    effects = graph.nodes.where("node_type = 'TRANSFORM'").select("file", F.col("id").alias("step"), transform_effect(F.col("node_subtype"), F.coalesce("code_snapshot", F.lit(""))).alias("effect"))
    steps = placed.where("path is not null").select("file", "source", "sink", F.explode("path").alias("step")).distinct().join(effects, ["file", "step"])
    seen = steps.groupBy("file", "source", "sink").agg(F.bool_or(F.col("effect") == "destruction").alias("blocked"), F.bool_or(F.col("effect") == "unknown").alias("unsure"))
    out = placed.join(seen, ["file", "source", "sink"], "left")
    strength = F.when(F.col("path").isNull(), "indicative").when(F.coalesce("unsure", F.lit(False)), "strong").otherwise("conclusive")
    return out.select(*findings.columns, "class", (F.size("path") - 1).alias("hops"), F.coalesce("blocked", F.lit(False)).alias("blocked"), strength.alias("strength"))


def reclassify(findings: DataFrame) -> DataFrame:
    """A certified class other than the reported weakness's corrects the number."""
    case = F.when(F.lit(False), F.lit(""))
    for name, numbers in CLASS_OF_CWE.items():
        case = case.when(F.col("class") == name, f"CWE-{numbers[0]}")
    own = class_of_cwe(F.col("cwe"))
    return findings.withColumn("cwe", F.when(own.isNotNull() & (own != F.col("class")), case).otherwise(F.col("cwe")))
