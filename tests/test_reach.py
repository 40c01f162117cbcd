"""Reachability against a plain search that carries the gate in its state."""

from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators import reach
from graphloom.schema import EDGES, FLOWS, NODES, Graph

TYPES = ("INGRESS", "CONTROL", "TRANSFORM", "STORAGE", "AUTH")


def graph(spark, types, edges, dirty):
    """Every list of types is one file; node k of file f is 'k'."""
    n, e, fl = [], [], []
    for f, ts in enumerate(types):
        for k, t in enumerate(ts):
            row = dict.fromkeys(NODES.names) | {"file": str(f), "id": str(k), "sequence": k, "label": "", "node_type": t, "node_subtype": "", "code_snapshot": ""}
            n.append(tuple(row[c] for c in NODES.names))
    for f, pairs in enumerate(edges):
        e += [(str(f), str(a), str(b), kind, k) for k, (a, b, kind) in enumerate(pairs)]
    for f, marks in enumerate(dirty):
        for k in marks:
            row = dict.fromkeys(FLOWS.names) | {"file": str(f), "node_id": str(k), "direction": "in", "pos": 0, "name": "x", "tainted": True, "sensitivity": "NONE"}
            fl.append(tuple(row[c] for c in FLOWS.names))
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), spark.createDataFrame(fl, FLOWS))


def search(types, edges, dirty, gate, ends_count):
    """(source, sink) pairs with a path on which no gate stood, by breadth-first search over (node, passed)."""
    out = set()
    for s, t in enumerate(types):
        if t != "INGRESS":
            continue
        stops = lambda k: types[k] == gate and (not ends_count or k in dirty)
        start = (s, ends_count and stops(s))
        seen, queue = {start}, deque([start])
        while queue:
            k, passed = queue.popleft()
            if not passed:
                out.add((s, k))
            for a, b, kind in edges:
                if a == k and kind not in ("CONTAINS", "DEPENDS"):
                    now = passed or (stops(b) if ends_count else (k != s and stops(k)))
                    if (b, now) not in seen:
                        seen.add((b, now))
                        queue.append((b, now))
    return out


one = st.integers(2, 7).flatmap(
    lambda n: st.tuples(
        st.lists(st.sampled_from(TYPES), min_size=n, max_size=n),
        st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.sampled_from(["DATA_FLOW", "CALLS", "CONTAINS"])), max_size=2 * n),
        st.sets(st.integers(0, n - 1)),
    )
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(one, min_size=25, max_size=25))
def test_gated_paths(spark, graphs):
    types, edges, dirty = zip(*graphs)
    g = graph(spark, types, edges, dirty)
    sources = g.nodes.where("node_type = 'INGRESS'")
    got = {(r.gate, r.file, int(r.seed), int(r.node)) for r in reach.paths_without_gate(g, sources, ["CONTROL", "AUTH"]).collect()}
    assert got == {(gate, str(f), *p) for f in range(len(types)) for gate in ("CONTROL", "AUTH") for p in search(types[f], edges[f], dirty[f], gate, True)}
    got = {(int(r.file), int(r.seed), int(r.node)) for r in reach.paths_without_intermediate(g, sources, ["TRANSFORM"]).collect()}
    assert got == {(f, *p) for f in range(len(types)) for p in search(types[f], edges[f], dirty[f], "TRANSFORM", False)}


def test_shortest_path_takes_the_first_of_equals(spark):
    g = graph(spark, [["INGRESS", "CONTROL", "CONTROL", "STORAGE"]], [[(0, 2, "CALLS"), (0, 1, "CALLS"), (1, 3, "CALLS"), (2, 3, "CALLS"), (3, 0, "CALLS")]], [[]])
    paths = {r.node: r.path for r in reach.shortest_paths(g, g.nodes.where("id = '0'")).collect()}
    assert paths["3"] == ["0", "2", "3"] and paths["0"] == ["0"]


def test_cycles_end_and_levels_put_them_last(spark):
    g = graph(spark, [["STORAGE"] * 5], [[(0, 1, "CALLS"), (1, 2, "CALLS"), (2, 1, "CALLS"), (2, 3, "CALLS")]], [[]])
    levels = {r.id: r.level for r in reach.topological_levels(g.edges, g.nodes).collect()}
    assert levels == {"0": 0, "4": 0, "1": 1, "2": 1, "3": 1}


def test_backward_tags_first_sink_wins(spark):
    g = graph(spark, [["INGRESS", "STORAGE", "STORAGE"]], [[(0, 1, "CALLS"), (0, 2, "CALLS"), (1, 2, "CALLS")]], [[]])
    sinks = g.nodes.where("node_type = 'STORAGE'").selectExpr("file", "id", "sequence", "concat('t', id) as tag")
    assert {r.node: r.tag for r in reach.backward_tags(g, sinks).collect()} == {"0": "t1", "1": "t2"}


def test_empty_graph(spark):
    g = graph(spark, [], [], [])
    assert reach.paths_without_gate(g, g.nodes, ["CONTROL"]).collect() == []


def test_reexports_stop_at_a_cycle(spark):
    rows = [("a", "b", "x", False, 1), ("b", "c", "*", True, 1), ("c", "d", "x", True, 2), ("d", "b", "*", True, 1)]
    imports = spark.createDataFrame(rows, "from_file string, to_file string, name string, is_reexport boolean, line int")
    assert [(r.from_file, r.origin) for r in reach.resolve_reexports(imports).collect()] == [("a", "d")]


def test_reexports_follow_long_chains(spark):
    rows = [("a", "f0", "x", False, 1), *((f"f{k}", f"f{k + 1}", "x", True, 1) for k in range(53))]
    imports = spark.createDataFrame(rows, "from_file string, to_file string, name string, is_reexport boolean, line int")
    assert [(r.from_file, r.origin) for r in reach.resolve_reexports(imports).collect()] == [("a", "f53")]
