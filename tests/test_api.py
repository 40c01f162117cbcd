from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import certificates, properties
from graphloom.plans.catalogue import default_rules

VULNERABLE = "import os\ndef run():\n    name = input()\n    os.system('ls ' + name)\n"
SAFE = "import os, shlex\ndef run():\n    name = shlex.quote(input())\n    os.system('ls ' + name)\n"


def graphs(spark):
    return api.python_graphs(spark.createDataFrame([("bad.py", VULNERABLE), ("good.py", SAFE)], "file string, source_code string"))


def test_scan_finds_the_command_injection_only(spark):
    g = graphs(spark)
    found = api.scan(g)
    assert {(r.file, r.cwe) for r in found.collect()} == {("bad.py", "CWE-78")}
    assert api.has_security_issues(g)
    meant = spark.createDataFrame([("bad", ".*")], "file_prefix string, sink_pattern string")
    assert api.apply_policy(found, meant).count() == 0 and api.apply_policy(found, mode="first_party").count() == 1


def test_rules_join_in_and_properties_cover_theirs(spark):
    found = api.scan(graphs(spark), default_rules(spark).where("source_type = 'INGRESS' and sink_type = 'EXTERNAL'"))
    rows = {(r.file, r.cwe) for r in found.collect()}
    assert ("bad.py", "CWE-78") in rows and len({c for f, c in rows if f == "bad.py"}) > 5


def test_certificates(spark):
    g = graphs(spark)
    findings = properties.to_findings(properties.taint_reachability(g)).select("file", "cwe", "source", "sink")
    (row,) = certificates.certify(g, findings).collect()
    assert (row["class"], row.hops, row.blocked, row.strength) == ("command", 1, False, "conclusive")
    wrong = certificates.certify(g, findings.withColumn("cwe", F.lit("CWE-89")))
    assert [r.cwe for r in certificates.reclassify(wrong).collect()] == ["CWE-77"]


def test_scan_a_folder(spark, tmp_path):
    (tmp_path / "bad.py").write_text(VULNERABLE)
    assert [r.cwe for r in api.scan_directory(spark, str(tmp_path)).collect()] == ["CWE-78"]


def test_origin_violations(spark):
    from tests.test_reach import graph

    g = graph(spark, [["STORAGE", "STORAGE"]], [[]], [[]])
    nodes = g.nodes.withColumn("node_subtype", F.when(F.col("id") == "0", "db_write").otherwise("db_read")).withColumn("code_snapshot", F.lit("update owner_id"))
    origins = spark.createDataFrame([("owner_id",)], "field string")
    assert [r.id for r in api.origin_violations(type(g)(nodes, g.edges, g.flows), origins).collect()] == ["0"]


def test_scoped_rules_look_at_the_whole_function(spark):
    from graphloom.operators import rules

    code = "def a():\n    open(input())\ndef b():\n    p = input()\n    check(p)\n    open(p)\n"
    g = api.python_graphs(spark.createDataFrame([("x.py", code)], "file string, source_code string"))
    family = rules.path_traversal(spark, [("CWE-23", "relative"), ("CWE-36", "absolute")])
    found = rules.evaluate_scoped(g, family).join(g.nodes.select("file", F.col("id").alias("sink"), "line_start"), ["file", "sink"])
    assert {(r.cwe, r.line_start) for r in found.collect()} == {("CWE-23", 2), ("CWE-36", 2)}
