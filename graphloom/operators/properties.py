"""Nine semantic properties, each one query over the graph's tables.

Every property returns violations: property, file, source, sink, sink_type,
sink_subtype, missing, via, description. Mapping them to weaknesses is a join
with an ordered table in which the first match wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import neutralized_bits, required_state, state_bits, STATES
from graphloom.operators import reach
from graphloom.schema import Graph

COLUMNS = ("property", "file", "source", "sink", "sink_type", "sink_subtype", "missing", "via", "description")

# Fixed values: (property, order, weakness, sink type, sink subtypes, missing, severity); empty means any.
SQL, NOSQL = "sql_query sql_write sql_read db_read db_write db_stored_proc", "nosql_query nosql_write nosql_read"
MAPPINGS = [
    ("taint-reachability", 0, "CWE-89", "STORAGE", SQL, "sanitization", "critical"),
    ("taint-reachability", 1, "CWE-943", "STORAGE", NOSQL, "sanitization", "critical"),
    ("taint-reachability", 2, "CWE-79", "EGRESS", "http_response html_render template_render", "encoding", "high"),
    ("taint-reachability", 3, "CWE-78", "EXTERNAL", "system_exec shell_exec process_spawn", "sanitization", "critical"),
    ("taint-reachability", 4, "CWE-77", "EXTERNAL", "command_exec eval", "sanitization", "critical"),
    ("taint-reachability", 5, "CWE-22", "STORAGE", "file_read file_write file_access", "validation", "high"),
    ("taint-reachability", 6, "CWE-90", "EXTERNAL", "ldap_query ldap_search", "sanitization", "high"),
    ("taint-reachability", 7, "CWE-643", "EXTERNAL", "xpath_query xpath_evaluate", "sanitization", "high"),
    ("taint-reachability", 8, "CWE-918", "EXTERNAL", "http_request url_fetch network_connect", "validation", "high"),
    ("taint-reachability", 9, "CWE-611", "EXTERNAL", "xml_parse xml_process", "validation", "high"),
    ("taint-reachability", 10, "CWE-94", "EXTERNAL", "code_eval dynamic_import script_exec", "sanitization", "critical"),
    ("taint-reachability", 11, "CWE-601", "EGRESS", "redirect url_redirect http_redirect", "validation", "medium"),
    ("taint-reachability", 12, "CWE-502", "EXTERNAL", "deserialize unserialize unpickle", "validation", "critical"),
    ("missing-auth", 0, "CWE-285", "STORAGE", "", "", "high"),
    ("missing-auth", 1, "CWE-862", "", "", "", "high"),
    ("sensitive-exposure", 0, "CWE-200", "EGRESS", "", "", "medium"),
    ("sensitive-exposure", 1, "CWE-312", "STORAGE", "", "", "high"),
    ("weak-crypto", 0, "CWE-327", "", "hash encrypt", "encryption", "high"),
    ("weak-crypto", 1, "CWE-321", "", "", "encryption", "critical"),
    ("resource-lifecycle", 0, "CWE-401", "", "", "lifecycle", "medium"),
    ("integer-overflow", 0, "CWE-190", "TRANSFORM", "", "", "high"),
    ("buffer-size", 0, "CWE-119", "", "", "", "critical"),
    ("sentinel-collision", 0, "CWE-138", "", "", "", "medium"),
]

WEAK_ALGORITHMS = {"MD5": r"(?i)\bmd5\b", "SHA-1": r"(?i)\bsha-?1\b", "DES": r"(?i)\bdes\b", "3DES": r"(?i)\b3des\b", "RC4": r"(?i)\brc4\b", "RC2": r"(?i)\brc2\b", "Blowfish": r"(?i)\bblowfish\b", "ECB": r"(?i)\becb\b"}
RELEASE = r"(?i)\b(close|release|disconnect|destroy|dispose|unlock|end|finish|free)\b"
ACQUIRING = ("file_read", "file_write", "db_connect", "socket_read", "socket_write", "lock_acquire")
ARITHMETIC = ("arithmetic", "format", "parse")
ARITHMETIC_CODE = r"(?i)[+\-*/%]\s*=|[+\-*/%]\s+\w|Math\.(abs|ceil|floor|round|pow)|parseInt|parseLong|parseFloat|Number\(|Integer\.valueOf|Long\.valueOf"
INT32 = (-2147483648, 2147483647)


def _named(df: DataFrame, prop: str, via: str, missing: Column | str, description: Column) -> DataFrame:
    missing = F.lit(missing) if isinstance(missing, str) else missing
    return df.select(F.lit(prop).alias("property"), "file", "source", "sink", "sink_type", "sink_subtype", missing.alias("missing"), F.lit(via).alias("via"), description.alias("description"))


def _pairs(reached: DataFrame, sinks: DataFrame) -> DataFrame:
    to = sinks.select("file", F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"))
    return reached.select("file", F.col("seed").alias("source"), F.col("node").alias("sink")).join(to, ["file", "sink"])


def missing_for(subtype: Column) -> Column:
    """What a dangerous sink lacks."""
    encoding = subtype.rlike("response|render") | (subtype == "xss_sink")
    validation = subtype.rlike("^file_|redirect|http_request|url_fetch|xml_|deserialize|unserialize")
    return F.when(subtype.startswith("file_"), "validation").when(encoding, "encoding").when(validation, "validation").otherwise("sanitization")


def taint_reachability(graph: Graph) -> DataFrame:
    """Taint reaches a storage, external or egress node with no neutraliser on some path.

    A source that has outputs of which none is tainted doesn't count.
    """
    out = graph.outputs().groupBy("file", F.col("node_id").alias("id")).agg(F.bool_or("tainted").alias("dirty"))
    sources = graph.nodes.where("node_type = 'INGRESS'").join(out, ["file", "id"], "left").where("coalesce(dirty, true)")
    sinks = graph.nodes.where("node_type in ('STORAGE', 'EXTERNAL', 'EGRESS') and node_subtype <> ''")
    found = _pairs(reach.paths_avoiding(graph, sources, reach.neutralizers(graph)), sinks)
    return _named(found, "taint-reachability", "property_bfs", missing_for(F.col("sink_subtype")), F.concat(F.lit("unneutralised path to "), "sink_type", F.lit("/"), "sink_subtype"))


def missing_auth(graph: Graph) -> DataFrame:
    """A privileged node is reachable from outside with no AUTH node on the way."""
    secret = graph.inputs().where("sensitivity in ('AUTH', 'FINANCIAL')").select("file", F.col("node_id").alias("id")).distinct().withColumn("secret", F.lit(True))
    surface = F.exists(F.coalesce("attack_surface", F.array().cast("array<string>")), lambda s: s.rlike("(?i)admin|privileged|delete|modify|write"))
    nodes = graph.nodes.join(secret, ["file", "id"], "left")
    sinks = nodes.where(F.coalesce("secret", F.lit(False)) | surface | F.col("node_subtype").isin("db_write", "db_stored_proc"))
    sources = graph.nodes.where("node_type = 'INGRESS'")
    found = _pairs(reach.paths_avoiding(graph, sources, reach.auth_nodes(graph)), sinks).where("source <> sink")
    return _named(found, "missing-auth", "property_bfs", "authorization", F.concat(F.lit("no auth before "), "sink_type", F.lit("/"), "sink_subtype"))


def sensitive_exposure(graph: Graph) -> DataFrame:
    """Sensitive data reaches an egress or log node unprotected."""
    sources = graph.nodes.join(graph.inputs().where("sensitivity <> 'NONE'").select("file", F.col("node_id").alias("id")).distinct(), ["file", "id"], "left_semi")
    sinks = graph.nodes.where("node_type = 'EGRESS' or (node_type = 'STORAGE' and node_subtype like '%log%')")
    found = _pairs(reach.paths_avoiding(graph, sources, reach.protecting_nodes(graph)), sinks).where("source <> sink")
    return _named(found, "sensitive-exposure", "property_bfs", "encryption", F.concat(F.lit("sensitive data reaches "), "sink_type", F.lit("/"), "sink_subtype"))


def weak_crypto(graph: Graph) -> DataFrame:
    """A crypto transform uses a weak algorithm or mode; else one whose key is written in the code."""
    text = F.concat_ws(" \n ", "algorithm_name", "code_snapshot", "analysis_snapshot")
    weak = reduce(lambda acc, kv: acc.when(text.rlike(kv[1]), kv[0]), list(WEAK_ALGORITHMS.items())[1:], F.when(text.rlike(WEAK_ALGORITHMS["MD5"]), "MD5"))
    crypto = graph.nodes.where("node_type = 'TRANSFORM' and node_subtype in ('hash', 'encrypt', 'decrypt')").withColumn("weak", weak)
    origin = graph.nodes.select("file", F.col("id").alias("source"), F.col("node_type").alias("t"), F.col("node_subtype").alias("s"))
    fixed = graph.inputs().join(origin, ["file", "source"], "left")
    hard = fixed.where("data_type in ('literal', 'constant') or t = 'STRUCTURAL' or s in ('constant', 'literal') or lower(name) like '%hardcoded%'")
    keyed = crypto.join(hard.select("file", F.col("node_id").alias("id")).distinct().withColumn("hard", F.lit(True)), ["file", "id"], "left").where("weak is not null or hard")
    found = keyed.select("file", F.col("id").alias("source"), F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"), "weak")
    return _named(found, "weak-crypto", "property_structural", "encryption", F.coalesce(F.concat(F.lit("weak algorithm "), F.col("weak")), F.lit("hard-coded key")))


def resource_lifecycle(graph: Graph) -> DataFrame:
    """A resource is acquired in a function in which nothing releases one; outside of functions nothing is said."""
    acquiring = graph.nodes.where(F.col("node_type").isin("RESOURCE", "STORAGE") & F.col("node_subtype").isin(*ACQUIRING))
    holders = graph.nodes.where("node_type = 'STRUCTURAL'").select("file", F.col("id").alias("src"), F.col("sequence").alias("at"))
    direct = graph.edges.where("edge_type = 'CONTAINS'").join(holders, ["file", "src"])
    owner = direct.groupBy("file", F.col("dst").alias("id")).agg(F.max_by("src", "at").alias("owner"))
    owned = acquiring.join(owner, ["file", "id"])
    scope = reach.containment(graph, owned.select("file", F.col("owner").alias("id")).distinct()).where("depth > 0")
    texts = graph.nodes.select("file", F.col("id").alias("node"), F.concat_ws(" \n ", "label", "code_snapshot", "analysis_snapshot").alias("text"))
    released = scope.join(texts, ["file", "node"]).where(F.col("text").rlike(RELEASE)).select("file", F.col("seed").alias("owner")).distinct()
    found = owned.join(released, ["file", "owner"], "left_anti").select("file", F.col("id").alias("source"), F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"))
    return _named(found, "resource-lifecycle", "property_structural", "lifecycle", F.concat(F.lit("never released: "), "sink_subtype"))


def integer_overflow(graph: Graph) -> DataFrame:
    """Arithmetic on tainted input whose range isn't known to fit 32 bits."""
    arithmetic = F.col("node_subtype").isin(*ARITHMETIC) | F.coalesce(F.col("code_snapshot").rlike(ARITHMETIC_CODE), F.lit(False))
    nodes = graph.nodes.where(F.col("node_type") == "TRANSFORM").where(arithmetic).select("file", F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"))
    r = F.col("range")
    fits = F.coalesce(r["bounded"] & (r["max"] <= INT32[1]) & (r["min"] >= INT32[0]), F.lit(False))
    inputs = graph.inputs().where("tainted").where(~fits).select("file", F.col("node_id").alias("sink"), F.coalesce("source", "node_id").alias("source"), "name")
    found = nodes.join(inputs, ["file", "sink"]).dropDuplicates(["file", "sink", "name"])
    return _named(found, "integer-overflow", "property_structural", "bounds_check", F.concat(F.lit("unbounded input "), "name"))


def buffer_size(graph: Graph) -> DataFrame:
    """A write may exceed the smallest size of its buffer; both known."""
    b, w = F.col("buffer_size"), F.col("write_size")
    nodes = graph.nodes.where(b["bounded"]).select("file", F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"), b["min"].alias("room"))
    writes = graph.inputs().where(w["bounded"]).select("file", F.col("node_id").alias("sink"), F.coalesce("source", F.lit("")).alias("source"), w["max"].alias("most"))
    found = nodes.join(writes, ["file", "sink"]).where("most > room")
    over = (F.col("most") - F.col("room")).cast("bigint").cast("string")
    return _named(found, "buffer-size", "property_structural", "bounds_check", F.concat(F.lit("overflow of "), over))


SENTINEL = r"(\w+)\s*(?:===?|!==?|<|>|<=|>=)\s*(-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?))"
KEYWORDS = ("if", "while", "for", "return", "switch", "case", "typeof", "length")


def sentinel_collision(graph: Graph) -> DataFrame:
    """A control compares a variable with a special value that the variable's own range can take."""
    v, s = F.regexp_extract("code_snapshot", SENTINEL, 1), F.regexp_extract("code_snapshot", SENTINEL, 2)
    hexed = s.rlike("(?i)^-?0x")
    value = F.when(hexed, F.conv(F.regexp_replace(s, "(?i)^-?0x", ""), 16, 10).cast("double") * F.when(s.startswith("-"), -1).otherwise(1)).otherwise(s.try_cast("double"))
    checks = graph.nodes.where("node_type = 'CONTROL'").select("file", F.col("id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"), v.alias("name"), value.alias("sentinel"))
    checks = checks.where((F.col("name") != "") & F.col("sentinel").isNotNull() & ~F.isnan("sentinel") & ~F.col("name").isin(*KEYWORDS))
    r = F.col("range")
    outputs = graph.outputs().where(r.isNotNull()).select("file", "name", F.col("node_id").alias("source"), r.alias("range"))
    inside = ~r["bounded"] | ((F.col("sentinel") >= r["min"]) & (F.col("sentinel") <= r["max"]))
    found = checks.join(outputs, ["file", "name"]).where(inside).dropDuplicates(["file", "source", "sink", "name"])
    return _named(found, "sentinel-collision", "property_structural", "validation", F.concat(F.col("name"), F.lit(" can equal its sentinel")))


def state_vs_requirement(graph: Graph, story: DataFrame) -> DataFrame:
    """Fold each variable's story to its state at every sink, and compare it with what the sink needs.

    story: (file, ord, variable, taint_class, node_id). A state is eleven bits: taint
    clears them, a safe value sets them, a transform adds those of its subtype. All of
    that is a running OR since the last reset, so it is two windows and no loop.
    """
    nodes = graph.nodes.select("file", F.col("id").alias("node_id"), "node_type", "node_subtype")
    told = story.where("variable <> ''").join(nodes, ["file", "node_id"])
    w = "partition by file, variable order by ord rows between unbounded preceding and current row"
    reset = F.col("taint_class").isin("TAINTED", "SAFE")
    bits = F.when(F.col("taint_class") == "SAFE", F.lit(state_bits(list(STATES)))).when(F.col("taint_class") == "TRANSFORM", neutralized_bits(F.col("node_subtype"))).otherwise(0).cast("int")
    told = told.withColumn("reset", reset.cast("int")).withColumn("bits", bits)
    told = told.withColumn("segment", F.expr(f"sum(reset) over ({w})")).withColumn("origin", F.expr(f"last(case when reset = 1 then node_id end, true) over ({w})"))
    told = told.withColumn("state", F.expr("bit_or(bits) over (partition by file, variable, segment order by ord rows between unbounded preceding and current row)"))
    need = required_state(F.col("node_subtype"))
    at_sinks = told.where("taint_class = 'SINK' and segment > 0 and node_type in ('STORAGE', 'EXTERNAL', 'EGRESS')").withColumn("need", need).where("need is not null")
    at_sinks = at_sinks.withColumn("bit", F.expr("cast(pow(2, array_position(array(" + ", ".join(f"'{s}'" for s in STATES) + "), need) - 1) as int)"))
    found = at_sinks.where("(state & bit) = 0").select("file", F.col("origin").alias("source"), F.col("node_id").alias("sink"), F.col("node_type").alias("sink_type"), F.col("node_subtype").alias("sink_subtype"), "need", "variable")
    return _named(found, "state-vs-requirement", "property_sentence", missing_for(F.col("sink_subtype")), F.concat("variable", F.lit(" lacks "), "need"))


ALL = (taint_reachability, missing_auth, sensitive_exposure, weak_crypto, resource_lifecycle, integer_overflow, buffer_size, sentinel_collision)


def mapping_table(spark) -> DataFrame:
    rows = [(p, o, c, t or None, s.split() or None, m or None, v) for p, o, c, t, s, m, v in MAPPINGS]
    rows += [("state-vs-requirement", *r[1:]) for r in rows if r[0] == "taint-reachability"]
    return spark.createDataFrame(rows, "property string, ord int, cwe string, want_type string, want_subtypes array<string>, want_missing string, severity string")


def to_findings(violations: DataFrame) -> DataFrame:
    """Violations with the first weakness that matches; those that match none are dropped."""
    m = F.broadcast(mapping_table(violations.sparkSession))
    fits = (F.col("want_type").isNull() | (F.col("want_type") == F.col("sink_type"))) & (F.col("want_subtypes").isNull() | F.array_contains("want_subtypes", F.col("sink_subtype"))) & (
        F.col("want_missing").isNull() | (F.col("want_missing") == F.col("missing"))
    )
    matched = violations.join(m, "property").where(fits)
    first = matched.groupBy(*COLUMNS).agg(F.min_by(F.struct("cwe", "severity"), "ord").alias("m"))
    return first.select(*COLUMNS, "m.cwe", "m.severity")


def run_all(graph: Graph, story: DataFrame | None = None) -> DataFrame:
    """Every property's findings."""
    parts = [p(graph) for p in ALL] + ([state_vs_requirement(graph, story)] if story is not None else [])
    return to_findings(reduce(DataFrame.unionByName, parts).distinct())
