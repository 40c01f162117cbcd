"""Recursive operators: one frontier loop, many questions.

A path that avoids a gate exists exactly if the sink is reachable once the
gate's nodes are gone, so a gate is a filter on the graph and the loop carries
no state besides (seed, node). All gates run in one loop: the gate is part of
the key. Every round is one join of the frontier with the edges, written as a
table; visited pairs are anti-joined, so cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions.classify import neutralizes
from graphloom.schema import Graph
from graphloom.storage import settle

#: Rounds after which the visited parts are rewritten as one table.
COMPACT = 8


def closure(edges: DataFrame, seeds: DataFrame, keys: list[str], expandable: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(keys, seed, node, depth): everything reachable from ``seeds`` (keys, seed), seeds at depth 0.

    edges: (keys, src, dst). expandable: if given, (keys, node) from which paths go on; seeds always do.
    """
    # Both are read again in every round: once computed, not every time.
    edges = settle(edges.select(*keys, "src", "dst").distinct(), "edges")
    if expandable is not None:
        expandable = settle(expandable.select(*keys, "node").distinct(), "expandable")
    start = seeds.select(*keys, "seed", F.col("seed").alias("node")).distinct().withColumn("depth", F.lit(0))
    parts = [settle(start, "frontier")]
    frontier, rounds = parts[0], 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        out = frontier if expandable is None or rounds == 1 else frontier.join(expandable, [*keys, "node"], "left_semi")
        step = out.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, "seed", F.col("dst").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, parts).select(*keys, "seed", "node")
        step = step.join(visited, [*keys, "seed", "node"], "left_anti").withColumn("depth", F.lit(rounds))
        frontier = settle(step, "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > COMPACT:
            parts = [settle(reduce(DataFrame.unionByName, parts), "visited")]
    return reduce(DataFrame.unionByName, parts)


def loaded(graph: Graph) -> DataFrame:
    """(file, node): nodes with a tainted or sensitive input, which makes a gate effective."""
    return graph.inputs().where("tainted or sensitivity <> 'NONE'").select("file", F.col("node_id").alias("node")).distinct()


def effective_gates(graph: Graph, gates: list[str]) -> DataFrame:
    """(gate, file, node)."""
    typed = graph.nodes.where(F.col("node_type").isin(*gates)).select(F.col("node_type").alias("gate"), "file", F.col("id").alias("node"))
    return typed.join(loaded(graph), ["file", "node"], "left_semi").select("gate", "file", "node")


def _gated(edges: DataFrame, names: list[str]) -> DataFrame:
    return edges.select("file", "src", "dst").crossJoin(F.broadcast(edges.sparkSession.createDataFrame([(g,) for g in names], "gate string")))


def without(edges: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that touch no blocked node."""
    for end in ("src", "dst"):
        edges = edges.join(blocked.select(*keys, F.col("node").alias(end)), [*keys, end], "left_anti")
    return edges


def paths_without_gate(graph: Graph, sources: DataFrame, gates: list[str]) -> DataFrame:
    """R1: (gate, file, seed, node, depth) with a flow path on which no effective gate stands; both ends count."""
    keys, blocked = ["gate", "file"], effective_gates(graph, gates)
    edges = without(_gated(graph.flow_edges(), gates), blocked, keys)
    seeds = sources.select("file", F.col("id").alias("seed")).crossJoin(F.broadcast(sources.sparkSession.createDataFrame([(g,) for g in gates], "gate string")))
    seeds = seeds.join(blocked.withColumnRenamed("node", "seed"), [*keys, "seed"], "left_anti")
    return closure(edges, seeds, keys)


def paths_without_intermediate(graph: Graph, sources: DataFrame, gates: list[str]) -> DataFrame:
    """R2: as R1, but a gate is any node of the type, and the ends are exempt."""
    keys = ["gate", "file"]
    spark = graph.nodes.sparkSession
    names = F.broadcast(spark.createDataFrame([(g,) for g in gates], "gate string"))
    go_on = graph.nodes.select("file", F.col("id").alias("node"), "node_type").crossJoin(names).where("node_type <> gate")
    seeds = sources.select("file", F.col("id").alias("seed")).crossJoin(names)
    return closure(_gated(graph.flow_edges(), gates), seeds, keys, go_on)


def paths_avoiding(graph: Graph, sources: DataFrame, blocked: DataFrame) -> DataFrame:
    """(file, seed, node, depth) over flow edges with the ``blocked`` (file, node) gone: R3 and its relatives."""
    seeds = sources.select("file", F.col("id").alias("seed")).join(blocked.withColumnRenamed("node", "seed"), ["file", "seed"], "left_anti")
    return closure(without(graph.flow_edges().select("file", "src", "dst"), blocked, ["file"]), seeds, ["file"])


def neutralizers(graph: Graph) -> DataFrame:
    """R3's blocked nodes: neutralising transforms, and loaded validation controls."""
    nodes = graph.nodes.select("file", F.col("id").alias("node"), "node_type", "node_subtype")
    plain = nodes.where((F.col("node_type") == "TRANSFORM") & neutralizes(F.col("node_subtype")))
    control = nodes.where((F.col("node_type") == "CONTROL") & F.col("node_subtype").isin("validation", "guard", "bounds_check")).join(loaded(graph), ["file", "node"], "left_semi")
    return plain.select("file", "node").union(control.select("file", "node"))


def auth_nodes(graph: Graph) -> DataFrame:
    return graph.nodes.where("node_type = 'AUTH'").select("file", F.col("id").alias("node"))


def protecting_nodes(graph: Graph) -> DataFrame:
    return graph.nodes.where((F.col("node_type") == "TRANSFORM") & F.col("node_subtype").rlike("^(encrypt|hash|sanitize)")).select("file", F.col("id").alias("node"))


def shortest_paths(graph: Graph, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """R4: (file, seed, node, path): the first shortest flow path, edges taken in their order.

    Breadth-first order among equal lengths is the order of the sequences of edge ordinals.
    """
    edges = settle(graph.flow_edges().select("file", "src", "dst", "ord"), "edges")
    start = sources.select("file", F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("way"))
    parts = [settle(start, "paths")]
    frontier, rounds = parts[0], 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = frontier.withColumnRenamed("node", "src").join(edges, ["file", "src"]).select(
            "file", "seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("ord")).alias("way")
        )
        step = step.groupBy("file", "seed", "node").agg(F.min(F.struct("way", "path")).alias("b")).select("file", "seed", "node", "b.path", "b.way")
        visited = reduce(DataFrame.unionByName, parts).select("file", "seed", "node")
        frontier = settle(step.join(visited, ["file", "seed", "node"], "left_anti"), "paths")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts).select("file", "seed", "node", "path")


def trace_gate(graph: Graph, pairs: DataFrame, gate: str) -> DataFrame:
    """R4a: (file, source, sink, verdict): VULNERABLE, GATED or NO_PATH for pairs (file, source, sink)."""
    sources = pairs.select("file", F.col("source").alias("id")).distinct()
    free = paths_without_gate(graph, sources, [gate]).select("file", F.col("seed").alias("source"), F.col("node").alias("sink"), F.lit(True).alias("free"))
    any_path = closure(graph.flow_edges(), sources.withColumnRenamed("id", "seed"), ["file"]).select("file", F.col("seed").alias("source"), F.col("node").alias("sink"), F.lit(True).alias("any"))
    on = ["file", "source", "sink"]
    verdict = F.when(F.col("free"), "VULNERABLE").when(F.col("any"), "GATED").otherwise("NO_PATH")
    return pairs.select(*on).distinct().join(free, on, "left").join(any_path, on, "left").select(*on, verdict.alias("verdict"))


def containment(graph: Graph, owners: DataFrame) -> DataFrame:
    """R5: (file, seed, node, depth) down CONTAINS edges, the owner itself at depth 0."""
    edges = graph.edges.where("edge_type = 'CONTAINS'")
    return closure(edges, owners.select("file", F.col("id").alias("seed")), ["file"])


#: Subtypes of structural nodes that count as functions.
FUNCTION_SUBTYPES = ("function", "route", "method", "lambda")


def parents(graph: Graph) -> DataFrame:
    """(file, child, parent): the one parent of a child, by the last CONTAINS edge."""
    rows = graph.edges.where("edge_type = 'CONTAINS'")
    return rows.groupBy("file", F.col("dst").alias("child")).agg(F.max_by("src", F.struct("ord", "src")).alias("parent"))


def nearest_function(graph: Graph) -> DataFrame:
    """R6: (file, id, function, depth): the nearest enclosing function up the parents, itself excluded."""
    up = parents(graph).select("file", F.col("child").alias("src"), F.col("parent").alias("dst"))
    reach = closure(up, graph.nodes.select("file", F.col("id").alias("seed")), ["file"]).where("depth > 0")
    functions = graph.nodes.where((F.col("node_type") == "STRUCTURAL") & F.col("node_subtype").isin(*FUNCTION_SUBTYPES)).select("file", F.col("id").alias("node"))
    found = reach.join(functions, ["file", "node"]).groupBy("file", F.col("seed").alias("id")).agg(F.min_by(F.struct("node", "depth"), "depth").alias("f"))
    return found.select("file", "id", F.col("f.node").alias("function"), F.col("f.depth").alias("depth"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    """R7: the same edges from target to source."""
    return edges.select("file", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "ord")


def backward_tags(graph: Graph, sinks: DataFrame) -> DataFrame:
    """R8: (file, node, tag): what lies upstream of the sinks (file, id, sequence, tag); the first sink wins."""
    back = graph.flow_edges().select("file", F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = closure(back, sinks.select("file", F.col("id").alias("seed")), ["file"]).where("depth > 0")
    # A sink is upstream of itself only on a cycle, where a step leads back to it.
    loops = back.join(reach.withColumnRenamed("node", "src"), ["file", "src"]).where("dst = seed").select("file", "seed", F.col("dst").alias("node")).distinct()
    tagged = reach.select("file", "seed", "node").union(loops).join(sinks.withColumnRenamed("id", "seed"), ["file", "seed"])
    return tagged.groupBy("file", "node").agg(F.min_by("tag", F.struct("sequence", "seed")).alias("tag"))


def taint_closure(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """R9: (file, node): nodes that taint reaches over CALLS and DATA_FLOW from nodes with a tainted output."""
    sources = graph.outputs().where("tainted").select("file", F.lit("taint").alias("seed"), F.col("node_id").alias("node")).distinct()
    edges = graph.edges.where("edge_type in ('CALLS', 'DATA_FLOW')").select("file", "src", "dst").distinct()
    parts = [settle(sources.select("file", "node"), "taint")]
    frontier, rounds = parts[0], 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = frontier.withColumnRenamed("node", "src").join(edges, ["file", "src"]).select("file", F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(reduce(DataFrame.unionByName, parts), ["file", "node"], "left_anti"), "taint")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """R10: (file, id, level): Kahn's rounds; members of cycles, and what only they lead to, come last at one level."""
    left = settle(nodes.select("file", "id").distinct(), "topo")
    links = settle(edges.where("src <> dst").select("file", "src", "dst").distinct(), "links")
    done, level = [], 0
    while True:
        held = links.select("file", F.col("dst").alias("id")).distinct()
        ready = settle(left.join(held, ["file", "id"], "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        done.append(ready)
        gone = ready.select("file", "id")
        left = settle(left.join(gone, ["file", "id"], "left_anti"), "topo")
        links = settle(links.join(gone.withColumnRenamed("id", "src"), ["file", "src"], "left_anti"), "links")
        level += 1
    done.append(left.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, done)


def resolve_reexports(imports: DataFrame) -> DataFrame:
    """R11: (from_file, name, origin): follow re-exports to the file that defines the name, a hop a round until nothing moves.

    imports: (from_file, to_file, name, is_reexport, line); '*' hands all names on. A
    cycle ends at the last file before it closes. Of several edges the first line counts.
    """
    hops = imports.where("is_reexport").groupBy(F.col("from_file").alias("via"), F.col("name").alias("hop_name")).agg(F.min_by("to_file", F.struct("line", "to_file")).alias("next"))
    now = imports.where("not is_reexport").select("from_file", "name", F.col("to_file").alias("at"), F.array("to_file").alias("seen"))
    done: list[DataFrame] = []
    while True:
        exact = hops.select(F.col("via").alias("v1"), F.col("hop_name").alias("n1"), F.col("next").alias("x1"))
        star = hops.where("hop_name = '*'").select(F.col("via").alias("v2"), F.col("next").alias("x2"))
        step = now.join(exact, (F.col("at") == F.col("v1")) & (F.col("name") == F.col("n1")), "left").join(star, F.col("at") == F.col("v2"), "left")
        step = step.withColumn("to", F.coalesce("x1", "x2"))
        on = F.col("to").isNotNull() & ~F.array_contains("seen", F.col("to"))
        now = settle(step.select("from_file", "name", F.when(on, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(on, F.concat("seen", F.array("to"))).otherwise(F.col("seen")).alias("seen"), on.alias("moved")), "reexport")
        # What stays where it is has arrived; only the others go on.
        done.append(now.where("not moved").select("from_file", "name", F.col("at").alias("origin")))
        now = now.where("moved").drop("moved")
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def per_group_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group under an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
