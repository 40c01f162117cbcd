"""Vocabulary lookups: joins with small tables in an order that is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Method names that mean something on any object.
WILDCARDS = {
    ("STORAGE", "db_read"): ["find", "findOne", "findAll", "findById", "findMany", "findUnique", "query", "select", "aggregate", "count"],
    ("STORAGE", "db_write"): ["save", "insert", "insertOne", "insertMany", "update", "updateOne", "updateMany", "delete", "deleteOne", "deleteMany", "create", "upsert", "remove"],
    ("TRANSFORM", "format"): ["toString", "toFixed", "padStart", "padEnd", "toUpperCase", "toLowerCase", "trim", "join"],
    ("TRANSFORM", "calculate"): ["reduce", "sort", "map"],
    ("RESOURCE", "connections"): ["getConnection", "acquire", "createPool"],
    ("RESOURCE", "memory"): ["alloc", "allocUnsafe", "malloc"],
}
NOT_A_STORE = ["Map", "Set", "WeakMap", "WeakSet", "WeakRef", "Array", "Object", "String", "Number", "Math", "JSON", "Promise", "console", "document", "window", "React", "Buffer", "process", "path", "fs", "list", "items", "values", "keys", "args", "params"]
SANITIZER = r"(?i)^(sanitize|escape|encode|purify|neutralize|filter|clean|strip)"
SANITIZER_STRICT = r"(?i)^(sanitize|purify|neutralize)\w*$|(?i)^(escape|encode|filter|clean|strip)(html|xml|sql|url|uri|shell|input|tags|path|js)\w*$"
# Modules by what they are for.
MODULES = {
    "http": ["http", "https", "express", "koa", "fastify", "axios", "node-fetch", "got", "request", "superagent"],
    "database": ["mysql", "mysql2", "pg", "mongodb", "mongoose", "sequelize", "knex", "typeorm", "prisma", "sqlite3", "redis"],
    "filesystem": ["fs", "fs-extra", "path", "glob"],
    "process": ["child_process", "cluster", "os", "vm"],
    "crypto": ["crypto", "bcrypt", "jsonwebtoken", "argon2"],
    "template": ["ejs", "pug", "handlebars", "mustache", "nunjucks"],
    "parser": ["xml2js", "libxmljs", "js-yaml", "body-parser"],
    "auth": ["passport", "express-session", "cookie-session"],
    "security": ["helmet", "csurf", "cors", "validator", "joi"],
    "logging": ["winston", "pino", "morgan", "bunyan"],
}


def _in(name: Column, kind: tuple[str, str]) -> Column:
    return name.isin(*WILDCARDS[kind])


def callee(calls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """calls (…, chain ARRAY<STRING>) with node_type, node_subtype, tainted; nulls where nothing matches.

    vocabulary: (key, node_type, node_subtype, tainted): single names and 'object.method'. Order: the name or the exact
    member, the last two names, then method names that mean storage, a sanitiser, a format, a calculation, a resource;
    those of storage and sanitisers don't count on objects that are no stores.
    """
    chain, n = F.col("chain"), F.size("chain")
    first, last = F.get(chain, F.lit(0)), F.get(chain, n - 1)
    keyed = calls.withColumn("_exact", F.when(n == 1, first).when(n > 1, F.concat_ws(".", first, last))).withColumn("_two", F.when(n > 2, F.concat_ws(".", F.get(chain, n - 2), last)))
    v = F.broadcast(vocabulary)
    keyed = keyed.join(v.select(F.col("key").alias("_exact"), F.struct("node_type", "node_subtype", "tainted").alias("_m1")), "_exact", "left")
    keyed = keyed.join(v.select(F.col("key").alias("_two"), F.struct("node_type", "node_subtype", "tainted").alias("_m2")), "_two", "left")

    def as_(kind: str, subtype: str) -> Column:
        return F.struct(F.lit(kind).alias("node_type"), F.lit(subtype).alias("node_subtype"), F.lit(False).alias("tainted"))

    store = ~first.isin(*NOT_A_STORE)
    wild = F.when((n == 1) & first.rlike(SANITIZER_STRICT), as_("TRANSFORM", "sanitize"))
    for kind in WILDCARDS:
        if kind == ("TRANSFORM", "format"):
            wild = wild.when((n > 1) & last.rlike(SANITIZER) & store, as_("TRANSFORM", "sanitize"))
        wild = wild.when((n > 1) & _in(last, kind) & (store if kind[0] == "STORAGE" else F.lit(True)), as_(*kind))
    found = F.coalesce("_m1", "_m2", wild)
    return keyed.select(*calls.columns, found["node_type"].alias("node_type"), found["node_subtype"].alias("node_subtype"), found["tainted"].alias("tainted"))


def module_category(name: Column) -> Column:
    """What a module is for; the 'node:' prefix and subpaths don't count."""
    base = F.regexp_extract(F.regexp_replace(name, "^node:", ""), r"^(@[^/]+/[^/]+|[^/]+)", 1)
    case = F.when(F.lit(False), F.lit(""))
    for category, modules in MODULES.items():
        case = case.when(base.isin(*modules), category)
    return case


def middleware_flags(names: Column) -> Column:
    """(auth, rate_limit, csrf, validation) from the names in a middleware chain."""
    has = lambda p: F.exists(names, lambda m: m.rlike(p))
    return F.struct(has(r"(?i)auth|login|session|jwt|passport|permission|role").alias("auth"), has(r"(?i)rate.?limit|throttle|slow.?down").alias("rate_limit"), has(r"(?i)csrf|xsrf").alias("csrf"), has(r"(?i)valid|schema|sanitiz|joi|zod").alias("validation"))


def parameter_roles(usage: DataFrame) -> DataFrame:
    """(function, param, role) from usage facts (function, param, fact): invoked, read, written, method, passed."""
    has = lambda f: F.bool_or(F.col("fact") == f)
    u = usage.groupBy("function", "param").agg(*[has(f).alias(f) for f in ("invoked", "read", "written", "method", "passed")])
    role = F.when(F.col("invoked") & ~F.col("read"), "continuation").when(F.col("read"), "input").when(F.col("method"), "output").when(F.col("passed") | F.col("written"), "data").otherwise("unknown")
    return u.select("function", "param", role.alias("role"))


def library_files(nodes: DataFrame) -> DataFrame:
    """(file, is_library): by path, prototype and export assignments, or many functions with hardly any input."""
    code = F.concat_ws("\n", "analysis_snapshot", "code_snapshot")
    n = lambda p: F.sum(F.regexp_count(code, F.lit(p)))
    facts = nodes.groupBy("file").agg(
        n(r"\.\s*prototype\s*\.\s*\w+\s*=").alias("proto"), n(r"exports\.\w+\s*=").alias("named"), n(r"exports\.\w+\s*=\s*function").alias("named_functions"), n(r"\b\w+\.\w+\s*=\s*function\b").alias("methods"),
        n(r"module\.exports\s*=\s*\{").alias("literal"), n(r"module\.exports").alias("module"), F.count_if(F.col("node_type") == "STRUCTURAL").alias("structural"), F.count_if(F.col("node_type") == "INGRESS").alias("ingress"),
    )
    path = F.lower(F.regexp_replace("file", r"\\", "/")).rlike(r"node_modules|(?:express|fastify|koa|hapi|restify|connect)[\w-]*/lib|/lib/(?:middleware|utils|helpers|internal)")
    is_lib = path | (F.col("proto") >= 3) | ((F.col("literal") > 0) & (F.col("proto") >= 1)) | ((F.col("named_functions") > 0) & (F.col("named") >= 5)) | ((F.col("methods") >= 8) & (F.col("module") > 0)) | ((F.col("structural") > 20) & (F.col("ingress") <= 2) & (F.col("methods") >= 5))
    return facts.select("file", is_lib.alias("is_library"))


def web_context(nodes: DataFrame) -> DataFrame:
    """(file, is_web): code or node kinds that only web applications have."""
    code = F.concat_ws("\n", "analysis_snapshot", "code_snapshot")
    sign = code.rlike(r"(?i)express\(|fastify\(|new koa|@(?:Get|Post|Request)Mapping|@app\.route|HttpServlet|django|flask|\$_(?:GET|POST|REQUEST)|ActionController|http\.HandleFunc|gin\.")
    return nodes.groupBy("file").agg(F.bool_or(F.coalesce(sign, F.lit(False)) | F.col("node_subtype").isin("http_request", "http_response", "route")).alias("is_web"))


# What a transform does to a value that passes.
EFFECTS = {"codec": "encoding", "format": "type_coercion", "encrypt": "destruction", "parse": "format_constraint", "path_resolve": "path_normalization", "alloc": "none", "xml_parse": "xml_processing", "prng_weak": "none"}


def transform_effect(subtype: Column, code: Column) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for name, effect in EFFECTS.items():
        case = case.when(subtype == name, effect)
    case = case.when(code.rlike(r"(?i)\b(sanitize|htmlEscape|escapeHtml|encodeForHTML|xssFilter|DOMPurify|bleach)\b"), "destruction")
    case = case.when(code.rlike(r"(?i)\b(encode|encodeURI|encodeURIComponent|URLEncoder|Base64)\b"), "encoding")
    case = case.when(code.rlike(r"\b(parseInt|parseLong|parseDouble|parseFloat|Number\(|int\(|float\()"), "type_coercion")
    return case.when(code.rlike(r"(?i)\b(hash|digest|encrypt|cipher)\b"), "destruction").otherwise("unknown")


def manifest(files: DataFrame) -> DataFrame:
    """(file, category, module): what a corpus is built with, from its imports (file, specifier)."""
    return files.select("file", F.col("specifier").alias("module"), module_category(F.col("specifier")).alias("category")).where("category is not null").distinct()


def vocabulary(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, "key string, node_type string, node_subtype string, tainted boolean")
