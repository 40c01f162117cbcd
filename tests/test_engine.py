"""Operators on hand-made tables, front ends, and the rescan stream."""

import random

from pyspark.sql import functions as F

from graphloom.functions import classify as C
from graphloom.operators import control, crossfile, findings, rules, story
from graphloom.sources import comments, css_graph, files, html_graph, python_graph
from graphloom.streaming import rescan


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_sensitivity_takes_the_strongest(spark):
    for name, level in (("userPassword", "SECRET"), ("EMAIL_token", "SECRET"), ("first_name", "PII"), ("sessionId", "AUTH"), ("Price", "FINANCIAL"), ("colour", "NONE")):
        assert one(spark, C.sensitivity(F.col("n")), n=name) == level


def test_sink_domain_and_gate(spark):
    assert one(spark, C.sink_domain(F.col("s"), F.col("c")), s="x", c="child_process.run") == "SHELL"
    assert one(spark, C.sink_domain(F.col("s"), F.col("c")), s="db_write", c="exec(") == "SQL"
    assert one(spark, C.cwe_fits_domain(F.col("w"), F.col("d")), w="CWE-89", d="HTML") is False
    assert one(spark, C.cwe_fits_domain(F.col("w"), F.col("d")), w="CWE-89", d="UNKNOWN") is True
    assert one(spark, C.cwe_fits_domain(F.col("w"), F.col("d")), w="CWE-1", d="HTML") is True


def test_neutralisers(spark):
    assert one(spark, C.neutralizes(F.col("s")), s="sanitize_html") and one(spark, C.neutralizes(F.col("s")), s="prepared_statement")
    assert not one(spark, C.neutralizes(F.col("s")), s="sanitizer") and not one(spark, C.neutralizes(F.col("s")), s="parse")
    assert one(spark, C.neutralized_bits(F.col("s")), s="sanitize_other") == C.state_bits(["xss_safe", "shell_safe"])


def test_ranges(spark):
    r = C.range_of(F.col("a"), F.col("b"))
    assert one(spark, r, a=0.0, b=float("inf")).bounded is False and one(spark, r, a=0.0, b=9.0).bounded is True


def test_storage_targets(spark):
    for code, want in (("SELECT * FROM Users", ("table", "users")), ("process.env.KEY", ("env", "KEY")), ("readFile('a.txt')", ("file", "a.txt")), ("prisma.order.findMany()", ("table", "order"))):
        assert tuple(one(spark, C.storage_target(F.col("c")), c=code)) == want
    assert one(spark, C.storage_target(F.col("c")), c="x + 1") is None


def test_dedup_keeps_effective_control(spark):
    rows = [(1, "f", "CWE-1", "a", "b", "CONTROL (x)", "low"), (2, "f", "CWE-1", "a", "b", "CONTROL (y)", "high"), (3, "f", "CWE-1", "a", "b", "EFFECTIVE_CONTROL", "low"), (4, "f", "CWE-1", "a", "b", "EFFECTIVE_CONTROL", "low")]
    df = spark.createDataFrame(rows, "ord int, file string, cwe string, source string, sink string, missing string, severity string")
    assert sorted(r.ord for r in findings.dedup(df).collect()) == [2, 3, 4]


def test_family_prefers_the_parent(spark):
    rows = [(1, "f", "CWE-23", "a", "b", "CONTROL", "critical"), (2, "f", "CWE-22", "a", "b", "CONTROL", "low"), (3, "f", "CWE-80", "a", "b", "CONTROL", "low"), (4, "f", "CWE-500", "a", "b", "CONTROL", "low")]
    df = spark.createDataFrame(rows, "ord int, file string, cwe string, source string, sink string, missing string, severity string")
    assert sorted((r.ord, r.collapsed_cwes) for r in findings.family_dedup(df).collect()) == [(2, "CWE-23"), (3, ""), (4, "")]


def chain(**kw):
    base = {"ord": 0, "file": "f", "cwe": "CWE-1", "source": "s", "sink": "k", "severity": "low", "sink_kind": None, "sink_name": None, "source_kind": None, "source_name": None, "sink_boundary": "", "source_boundary": "", "sink_type": "STORAGE", "sink_subtype": "db_write", "source_type": "INGRESS", "source_subtype": "db_read"}
    return tuple((base | kw).values())


def test_composition(spark):
    schema = "ord int, file string, cwe string, source string, sink string, severity string, sink_kind string, sink_name string, source_kind string, source_name string, sink_boundary string, source_boundary string, sink_type string, sink_subtype string, source_type string, source_subtype string"
    rows = [
        chain(ord=1, sink_kind="table", sink_name="u", sink_boundary="storage", source_boundary="network_external", severity="high"),
        chain(ord=2, file="g", source="k", sink="z", source_kind="table", source_name="u"),
        chain(ord=3, file="f", source="k", sink="m"),
        chain(ord=4, file="h", sink_kind="env", sink_name="E", sink_type="INGRESS", sink_subtype="env_read", source_kind="env", source_name="E"),
        chain(ord=5, file="i", sink_kind="env", sink_name="E", sink_type="INGRESS", sink_subtype="env_read", source_kind="env", source_name="E"),
    ]
    got = sorted((r.first, r.second, r.chain_type, r.boundaries, r.severity) for r in findings.compose(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2, "storage_bridge", 1, "critical"), (1, 3, "same_node", 0, "critical")]


def plain_chains(rows):
    """Plain reading of the composition rule, over rows of :func:`chain`."""
    found, rank = {}, ["low", "medium", "high", "critical"]
    write = lambda kind, sub: sub in findings.WRITES or kind in ("EGRESS", "STORAGE") and sub is not None and sub != "http_request"
    name = lambda x: None if None in (x[1], x[3], x[4]) else f"{x[1]}:{x[3]}->{x[4]}"
    for a in rows:
        for b in rows:
            meets = a[6] is not None and a[7] is not None and (a[6], a[7]) == (b[8], b[9])
            same = not meets and a[1] is not None and a[4] is not None and (a[1], a[4]) == (b[1], b[3])
            if a[0] == b[0] or not (meets and (write(a[12], a[13]) or write(b[14], b[15])) or same):
                continue
            kind = "same_node" if same else {"file": "file_bridge", "env": "env_bridge"}.get(a[6], "storage_bridge")
            crossed = 0 if same else max(0, len({x for x in (*a[10:12], *b[10:12]) if x}) - 1)
            both = [x for x in (name(a), name(b)) if x is not None]
            pair = f"{min(both)}||{max(both)}" if both else ""
            found.setdefault(pair, []).append((a[0], b[0], kind, crossed, rank[min(3, max(rank.index(a[5]), rank.index(b[5])) + 1)]))
    return sorted(min(x) for x in found.values())


def test_composition_against_all_pairs(spark):
    schema = "ord int, file string, cwe string, source string, sink string, severity string, sink_kind string, sink_name string, source_kind string, source_name string, sink_boundary string, source_boundary string, sink_type string, sink_subtype string, source_type string, source_subtype string"
    for seed, nodes in enumerate((["a", "b", "c", "d"], ["a", "b", None, "a|", "|a", "b||b"], [f"n{k}" for k in range(60)])):
        r = random.Random(seed)
        rows = [
            chain(ord=k, file=r.choice(["f", "g"]), source=r.choice(nodes), sink=r.choice(nodes), severity=r.choice(["low", "medium", "high"]), sink_kind=r.choice(["table", "file", "env", None]), sink_name=r.choice("uv"),
                  source_kind=r.choice(["table", "file", "env"]), source_name=r.choice(["u", "v", None]), sink_boundary=r.choice(["", "x", None]), source_boundary=r.choice(["x", "y"]), sink_type=r.choice(["STORAGE", "INGRESS"]),
                  sink_subtype=r.choice(["env_read", "http_request", None]), source_subtype=r.choice(["db_read", "log_write"]))
            for k in range(30)
        ]
        got = sorted(tuple(x) for x in findings.compose(spark.createDataFrame(rows, schema)).collect())
        assert len(got) > 20 and got == plain_chains(rows)


def test_composition_shuffles_no_pairs(spark):
    rows = spark.range(2000).selectExpr("id AS ord", "'f' AS file", "'CWE-1' AS cwe", "'s' || id AS source", "'k' || id AS sink", "'low' AS severity", "'table' AS sink_kind", "'t' AS sink_name", "'table' AS source_kind", "'t' AS source_name",
                                        "'' AS sink_boundary", "'' AS source_boundary", "'STORAGE' AS sink_type", "'db_write' AS sink_subtype", "'INGRESS' AS source_type", "'db_read' AS source_subtype")
    found = findings.compose(rows)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2000 * 1999 // 2


def test_inventory_gives_rules(spark):
    lines = ["| CWE | Name | Sev | Shape | Ops | missing |", "| 5 | A | high | STORAGE→EGRESS | P I:EXTERNAL X | EXTERNAL (encrypted) | x |", "| 6 | B | low | INGRESS | P T:CONTROL | CONTROL | x |"]
    rows = rules.rules_from_inventory(spark, lines).collect()
    assert [(r.cwe, r.mode, r.gate, r.source_type) for r in rows] == [("CWE-5", "I", "EXTERNAL", "STORAGE")]


def test_weak_controls(spark):
    rows = [("f", "1", "validate", "if (!/^(a+)+$/.test(x)) check()"), ("f", "2", "x", "if (req.body.id == user.id)"), ("f", "3", "sanitize", "s.replace(/x/g, '')"), ("f", "4", "x", "fine()")]
    df = spark.createDataFrame(rows, "file string, id string, node_subtype string, code_snapshot string")
    assert {(r.id, r.weakness) for r in control.weak_controls(df).collect()} == {("1", "redos"), ("2", "both_sides_user"), ("2", "loose_equality"), ("3", "strip_collapse")}


def test_story_order_and_state(spark):
    rows = [("f", 1, "SINK", 3, "v", "n3"), ("f", 1, "TAINTED", 2, "v", "n2"), ("f", 2, "SAFE", 4, "v", "n4"), ("f", 3, "SINK", 5, "v", "n5")]
    told = story.ordered(spark.createDataFrame(rows, "file string, line int, taint_class string, seq int, variable string, node_id string"))
    assert [(r.node_id, r.origin) for r in story.tainted_at_sinks(told).collect()] == [("n3", "n2")]


def test_imports_resolve(spark):
    imports = spark.createDataFrame([("src/a/x.js", "../b/y"), ("src/a/x.js", "./z"), ("src/a/x.js", "react")], "from_file string, specifier string")
    paths = spark.createDataFrame([("src/b/y.ts",), ("src/b/y/index.js",), ("src/a/z/index.js",)], "path string")
    got = {r.specifier: r.to_file for r in crossfile.resolve_imports(imports, paths).collect()}
    assert got == {"../b/y": "src/b/y.ts", "./z": "src/a/z/index.js", "react": None}


def test_return_taint_is_three_valued(spark):
    functions = spark.createDataFrame([("a", None), ("b", False), ("c", True), ("d", None)], "function string, own boolean")
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "function string, callee string")
    assert {r.function: r.taint for r in crossfile.return_taint(functions, calls).collect()} == {"a": True, "b": True, "c": True, "d": None}
    direct = spark.createDataFrame([("c", "sql_query")], "function string, subtype string")
    assert {r.function for r in crossfile.sink_contexts(direct, calls).collect()} == {"a", "b", "c"}


def test_dirty_files(spark):
    a = spark.createDataFrame([("f", "x", True), ("g", "y", False)], "file string, name string, tainted boolean")
    b = spark.createDataFrame([("f", "x", True), ("g", "y", True), ("h", "z", True)], "file string, name string, tainted boolean")
    assert {r.file for r in crossfile.dirty_files(a, b).collect()} == {"g", "h"}


def test_java_edges(spark):
    classes = spark.createDataFrame([("A.java", "p", "A"), ("B.java", "p", "B"), ("C.java", "q.r", "C")], "file string, package string, name string")
    uses = spark.createDataFrame([("A.java", "p", "q.r.C"), ("D.java", "z", "p.*")], "file string, package string, imported string")
    got = {(r.from_file, r.to_file) for r in crossfile.java_package_edges(classes, uses).collect()}
    assert got == {("A.java", "B.java"), ("A.java", "C.java"), ("D.java", "A.java"), ("D.java", "B.java")}


def test_python_front_end(spark):
    code = "import os\ndef f():\n    q = input()\n    w = 'x' + q\n    if w:\n        os.system(w)\n    os.system(shlex.quote(q))\n"
    nodes, edges, flows = python_graph.tables(spark.createDataFrame([("m.py", code), ("bad.py", "def ("), ("n.py", None)], "file string, source_code string"))
    kinds = {(r.node_type, r.node_subtype) for r in nodes.where("file = 'm.py'").collect()}
    assert {("INGRESS", "user_input"), ("EXTERNAL", "system_exec"), ("TRANSFORM", "sanitize_shell"), ("STRUCTURAL", "function"), ("CONTROL", "branch")} <= kinds
    assert nodes.where("node_subtype = 'parse_error'").count() == 1
    sinks = nodes.where("node_subtype = 'system_exec'").select("file", F.col("id").alias("node_id"))
    assert sorted(r.tainted for r in flows.join(sinks, ["file", "node_id"]).collect()) == [False, True]
    assert edges.where("edge_type = 'DATA_FLOW'").count() == 3


def test_html_and_css_front_ends(spark):
    page = "<!DOCTYPE html><body onload='go()'><form action=/x><input name=a></form><iframe src=y></iframe><!--[if IE]> x <![endif]--><a href=z>t</a><a name=n></a></body>"
    rows = html_graph.nodes(spark.createDataFrame([("p", page), ("q", None)], "file string, source_code string")).collect()
    assert [r.node_subtype for r in rows] == ["doctype", "event_handler", "form", "input", "iframe", "conditional_comment", "link"]
    sheet = "@import url('a.css'); :root{--x:1px} a:hover{width:var(--x)} @media print{p{color:red}} /* b{} */"
    got = {(r.node_subtype, r.label) for r in css_graph.nodes(spark.createDataFrame([("s", sheet)], "file string, source_code string")).collect()}
    assert {("url", "a.css"), ("custom_property", "--x"), ("var_reference", "--x"), ("media", "print"), ("rule", "a:hover"), ("rule", "p")} <= got and ("rule", "b") not in got


def test_comments():
    assert comments.strip_comments("a = '//' // x\n/* y\n */b", "javascript") == "a = '//' \n\nb"
    assert comments.strip_comments("a = '#' # x\nb = \"\"\"#\n\"\"\"", "python") == "a = '#' \nb = \"\"\"#\n\"\"\""
    assert comments.strip_comments("x # y", "javascript") == "x # y"


def test_scan_and_rescan(spark, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("print(input())")
    (src / "a.test.js").write_text("x")
    (src / "node_modules" / "b.js").write_text("x")
    rows = files.scan_directory(spark, str(src)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.language) for r in rows] == [("a.py", "python")]

    def analyse(batch):
        return python_graph.tables(batch)[0].select("file", "node_type")

    for k in range(2):
        rescan.rescan(rescan.watch(spark, str(src), "*.py"), analyse, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        (src / f"new{k}.py").write_text("eval(input())")
    rescan.rescan(rescan.watch(spark, str(src), "*.py"), analyse, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rescan.latest(spark.read.parquet(str(tmp_path / "out"))).count() == 6


def test_entry_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("graphloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr("graphloom.llm", raising=False)
    bare = importlib.reload(entry)
    assert "gated_reach_control" in bare.queries() and not any(q.startswith("op1_") for q in bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
