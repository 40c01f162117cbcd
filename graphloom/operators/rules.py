"""Rules as data: one query evaluates every rule that is a pair of node types and a path check.

A rule table row: cwe, name, severity, source_type, sink_type, mode ('T': no
effective gate on the path, ends included; 'I': no node of the type between),
gate, missing, safe_pattern (absent from both ends' code), languages (or null).
Paths are computed once per gate for all rules; a rule is then a join on
(gate, types). Later layers of a registry override earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import cwe_fits_domain, sink_domain
from graphloom.operators import reach
from graphloom.schema import NODE_TYPES, Graph

RULES = "cwe string, name string, severity string, source_type string, sink_type string, mode string, gate string, missing string, safe_pattern string, languages array<string>, domain_gate boolean"

# Patterns of code that makes a pair safe, by what a rule misses.
SAFE = {
    "V": r"\bvalidate\s*\(|\bcheck\s*\(|\bverif\w*\s*\(|\bassert\s*\(|\bguard\s*\(|\bensure\s*\(",
    "S": r"\bsanitize\s*\(|\bescape\s*\(|\bencode\s*\(|\.filter\s*\(|\bstrip\s*\(|\bneutralize\s*\(",
    "A": r"\bauthorize\s*\(|\bhasPermission\s*\(|\bcheckAccess\s*\(|\brole\b|\btoken\b.*\bverif\w*\s*\(|\bauth\s*\(",
    "E": r"\bencrypt\s*\(|\bhash\s*\(|\bcreateHash\b|\bcipher\s*\(|\bcreateCipher\w*\b|\bprotect\s*\(|\bsecure\s*\(",
    "L": r"\block\s*\(|\bmutex\b|\bsynchronized\b|\batomic\b|\btransaction\b",
    "R": r"\brelease\s*\(|\bclose\s*\(|\bdispose\s*\(|\bfinally\b|\bcleanup\s*\(",
    "I": r"\bimmutable\b|\.freeze\s*\(|\breadonly\b|\bconst\b|\.seal\s*\(",
    "D": r"\bdebug.*off\b|\bproduction\b|\bNODE_ENV\b",
    "CR": r"\bcrypto\.random\b|\brandomBytes\b|\bCSPRNG\b|\bgetRandomValues\b",
}
# What a rule's missing text speaks of decides its safe pattern.
SAFE_FOR = [("E", "encrypt|hash|cipher|crypto"), ("A", "auth|permission|access|role|owner"), ("L", "lock|synchron|atomic|race|transaction"), ("R", "release|close|dispose|cleanup|lifecycle"), ("S", "saniti|escap|encod|filter|neutrali"), ("D", "debug|production"), ("CR", "random|entropy|csprng"), ("I", "immutab|freez|readonly"), ("V", "")]


def safe_pattern_for(missing: str) -> str:
    low = missing.lower()
    return next(SAFE[k] for k, words in SAFE_FOR if re.search(words, low))


def rules_from_inventory(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Rule rows from a Markdown inventory: | cwe | name | severity | A→B | ops | missing | ...

    Rows whose shape isn't one pair of node types, or which name no path check,
    are no data rules and are left to their own operators.
    """
    rows = []
    for line in lines:
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if len(cells) < 6 or not cells[0].isdigit():
            continue
        ends = cells[3].split("→")
        check = re.search(r"\b([TI]):([A-Z]+)", cells[4])
        if len(ends) == 2 and check and all(e in NODE_TYPES for e in ends):
            rows.append((f"CWE-{cells[0]}", cells[1], cells[2], *ends, check[1], check[2], cells[5], "(?i)" + safe_pattern_for(cells[5]), None, True))
    return spark.createDataFrame(rows, RULES)


def evaluate(graph: Graph, rules: DataFrame) -> DataFrame:
    """(file, cwe, name, severity, source, sink, missing): every rule on every pair, through shared path tables."""
    gates = {(r.mode, r.gate) for r in rules.select("mode", "gate").distinct().collect()}
    starts = [r.source_type for r in rules.select("source_type").distinct().collect()]
    sources = graph.nodes.where(F.col("node_type").isin(starts))
    paths = None
    for mode, walk in (("T", reach.paths_without_gate), ("I", reach.paths_without_intermediate)):
        wanted = sorted(g for m, g in gates if m == mode)
        if wanted:
            found = walk(graph, sources, wanted).where("seed <> node").select(F.lit(mode).alias("mode"), "gate", "file", F.col("seed").alias("source"), F.col("node").alias("sink"))
            paths = found if paths is None else paths.unionByName(found)
    node = graph.nodes.select("file", "id", "node_type", "node_subtype", "code_snapshot", "language")
    src = node.select("file", F.col("id").alias("source"), F.col("node_type").alias("source_type"), F.col("code_snapshot").alias("source_code"))
    dst = node.select("file", F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("code_snapshot").alias("sink_code"), "language", sink_domain(F.col("node_subtype"), F.col("code_snapshot")).alias("domain"))
    pairs = paths.join(src, ["file", "source"]).join(dst, ["file", "sink"])
    hit = pairs.join(F.broadcast(rules), ["mode", "gate", "source_type", "sink_type"])
    safe = F.coalesce(F.expr("source_code rlike safe_pattern or sink_code rlike safe_pattern"), F.lit(False))
    spoken = F.col("languages").isNull() | F.array_contains("languages", F.col("language"))
    return hit.where(~F.col("domain_gate") | cwe_fits_domain(F.col("cwe"), F.col("domain"))).where(spoken & ~safe).select("file", "cwe", "name", "severity", "source", "sink", "missing")


def registry(layers: DataFrame) -> DataFrame:
    """One row per cwe: of (layer, cwe, name) the one of the latest layer."""
    return layers.groupBy("cwe").agg(F.max_by("name", "layer").alias("name"), F.max("layer").alias("layer"))


def collisions(layers: DataFrame) -> DataFrame:
    """Weaknesses that several layers define."""
    return layers.groupBy("cwe").agg(F.countDistinct("layer").alias("n_layers")).where("n_layers > 1")


def holds(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """(cwe, holds): a rule holds if nothing was found."""
    return rules.select("cwe").distinct().join(findings.select("cwe").distinct().withColumn("hit", F.lit(True)), "cwe", "left").select("cwe", F.col("hit").isNull().alias("holds"))


def covered_removed(rule_findings: DataFrame, property_findings: DataFrame) -> DataFrame:
    """A weakness that a property found in a file suppresses the rules of that number there."""
    return rule_findings.join(property_findings.select("file", "cwe").distinct(), ["file", "cwe"], "left_anti")


def language_filter(findings: DataFrame, rules_tags: DataFrame, graph_tags: DataFrame) -> DataFrame:
    """Drop findings of rules whose platform tags don't overlap the file's; unknown tags keep them."""
    known = findings.join(rules_tags, "cwe", "left").join(graph_tags, "file", "left")
    return known.where("rule_tags is null or file_tags is null or arrays_overlap(rule_tags, file_tags)").drop("rule_tags", "file_tags")


def evaluate_scoped(graph: Graph, rules: DataFrame) -> DataFrame:
    """Rules that also name their sinks, and whose safe pattern is looked for in the sink's whole function.

    rules: as RULES, with sink_pattern over the sink's subtype and code (null: any). Where a node has no enclosing
    function its own text is the scope. A function's text is its node's, comments stripped beforehand.
    """
    never = "(?!x)x"
    found = evaluate(graph, rules.drop("sink_pattern").withColumn("safe_pattern", F.lit(never)))
    own = graph.nodes.select("file", F.col("id").alias("sink"), F.concat_ws(" ", "node_subtype", "code_snapshot").alias("text"), F.col("code_snapshot").alias("own"))
    around = reach.nearest_function(graph).select("file", F.col("id").alias("sink"), "function")
    bodies = graph.nodes.select("file", F.col("id").alias("function"), F.col("code_snapshot").alias("body"))
    placed = found.join(own, ["file", "sink"]).join(around, ["file", "sink"], "left").join(bodies, ["file", "function"], "left")
    placed = placed.join(F.broadcast(rules.select("cwe", "sink_pattern", F.col("safe_pattern").alias("safe"))), "cwe")
    safe = F.coalesce(F.expr("coalesce(body, own) rlike safe"), F.lit(False))
    return placed.where(F.expr("sink_pattern is null or text rlike sink_pattern")).where(~safe).select("file", "cwe", "name", "severity", "source", "sink", "missing")


def path_traversal(spark: SparkSession, cwes: list[tuple[str, str]]) -> DataFrame:
    """The family of rules from input to file access: one row per (cwe, name)."""
    rows = [(c, n, "high", "INGRESS", "STORAGE", "T", "CONTROL", "CONTROL (path validation / directory restriction)", "(?i)" + SAFE["V"], None, True, r"(?i)file|path|open\s*\(") for c, n in cwes]
    return spark.createDataFrame(rows, RULES + ", sink_pattern string")
