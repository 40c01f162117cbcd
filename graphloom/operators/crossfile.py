"""Across files: import resolution, call edges, return taint, sink contexts, parameter taint, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import Graph
from graphloom.storage import settle

EXTENSIONS = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts")


def normal_path(path: Column) -> Column:
    """POSIX normal form of a relative path: no '.', '..' takes its parent away."""
    def fold(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((part == ".") | (part == ""), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (from_file, specifier) with to_file: exact path, then extensions, then index files; null for packages."""
    folder = F.regexp_replace(F.col("from_file"), r"[^/]*$", "")
    base = F.when(F.col("specifier").startswith("."), normal_path(F.concat(folder, "specifier"))).otherwise(F.when(F.col("specifier").startswith("/"), F.col("specifier")))
    tries = F.transform(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(EXTENSIONS)]), lambda t: F.struct(t["rank"].alias("rank"), F.concat(F.col("base"), t["ext"]).alias("path")))
    wanted = imports.withColumn("base", base).where("base is not null").withColumn("t", F.explode(tries)).select(*imports.columns, "t.rank", "t.path")
    found = wanted.join(paths.select("path").distinct(), "path").groupBy(*imports.columns).agg(F.min_by("path", "rank").alias("to_file"))
    return imports.join(found, imports.columns, "left")


def imports_of(files: DataFrame) -> DataFrame:
    """(file, specifier, imported): import and require statements of (file, source_code)."""
    code = F.col("source_code")
    named = F.regexp_extract_all(code, F.lit(r"import\s+([\w*{}\s,$]+?)\s+from\s+['\"][^'\"]+['\"]"), F.lit(1))
    froms = F.regexp_extract_all(code, F.lit(r"import\s+[\w*{}\s,$]+?\s+from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    required = F.regexp_extract_all(code, F.lit(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), F.lit(1))
    es = F.arrays_zip(froms.alias("specifier"), named.alias("imported"))
    cjs = F.transform(required, lambda s: F.struct(s.alias("specifier"), F.lit("*").alias("imported")))
    return files.select("file", F.explode(F.concat(es, cjs)).alias("i")).select("file", "i.specifier", "i.imported")


def call_edges(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, caller, callee): call sites are tokenised once and joined by name, instead of searching each name in each text."""
    sites = nodes.select("file", F.col("id").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("code_snapshot", F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name"))
    return sites.join(functions.select("file", "name", F.col("id").alias("callee")), ["file", "name"]).where("caller <> callee").select("file", "caller", "callee").distinct()


def java_package_edges(classes: DataFrame, uses: DataFrame) -> DataFrame:
    """(from_file, to_file) by exact import, wildcard import or shared package.

    classes: (file, package, name). uses: (file, package, imported) with 'a.b.C', 'a.b.*' or null.
    """
    c = classes.select(F.col("file").alias("to_file"), F.col("package").alias("to_package"), "name")
    exact = uses.join(c, F.col("imported") == F.concat_ws(".", "to_package", "name")).select(F.col("file").alias("from_file"), "to_file")
    wild = uses.where("imported like '%.*'").join(c, F.col("imported") == F.concat(F.col("to_package"), F.lit(".*"))).select(F.col("file").alias("from_file"), "to_file")
    same = uses.select("file", "package").distinct().join(c, F.col("package") == F.col("to_package")).select(F.col("file").alias("from_file"), "to_file")
    return exact.union(wild).union(same).where("from_file <> to_file").distinct()


def return_taint(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(function, taint): true if a callee's is, else the function's own: true, false or unknown (null).

    functions: (function, own BOOLEAN NULL); calls: (function, callee). True spreads against the calls until nothing changes.
    """
    dirty = settle(functions.where("own").select("function"), "returns")
    parts = [dirty]
    while True:
        step = calls.join(parts[-1].withColumnRenamed("function", "callee"), "callee").select("function").distinct()
        new = settle(step.join(reduce(DataFrame.union, parts), "function", "left_anti"), "returns")
        if new.isEmpty():
            break
        parts.append(new)
    hit = reduce(DataFrame.union, parts).withColumn("hit", F.lit(True))
    return functions.join(hit, "function", "left").select("function", F.when(F.col("hit"), True).otherwise(F.col("own")).alias("taint"))


def sink_contexts(direct: DataFrame, calls: DataFrame) -> DataFrame:
    """(function, subtype): the sinks a function reaches itself or through calls, any number of hops."""
    parts = [settle(direct.select("function", "subtype").distinct(), "sinks")]
    while True:
        step = calls.join(parts[-1].withColumnRenamed("function", "callee"), "callee").select("function", "subtype").distinct()
        new = settle(step.join(reduce(DataFrame.union, parts), ["function", "subtype"], "left_anti"), "sinks")
        if new.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(new)


def dirty_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose flows differ, by the sum of row hashes: only these are verified again."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("file").agg(F.sum(F.xxhash64(*[c for c in sorted(df.columns) if c not in ("range", "write_size")]).cast("decimal(38,0)")).alias(name))

    return digest(before, "b").join(digest(after, "a"), "file", "full").where("not (a <=> b)").select("file")


def merge(graph: Graph, parent: str, links: DataFrame) -> Graph:
    """One graph of many: ids get their file as prefix; links (from_file, from_id, to_file, to_id) become CALLS edges."""
    def key(file: str, id_: str) -> Column:
        return F.concat(F.lit(f"{parent}_"), F.col(file), F.lit("::"), F.col(id_))

    nodes = graph.nodes.withColumn("id", key("file", "id")).withColumn("file", F.lit(parent))
    edges = graph.edges.withColumn("src", key("file", "src")).withColumn("dst", key("file", "dst")).withColumn("file", F.lit(parent))
    crossing = links.select(F.lit(parent).alias("file"), key("from_file", "from_id").alias("src"), key("to_file", "to_id").alias("dst"), F.lit("CALLS").alias("edge_type"), F.lit(0).cast("long").alias("ord"))
    flows = graph.flows.withColumn("node_id", key("file", "node_id")).withColumn("source", F.when(F.col("source").isNotNull(), key("file", "source"))).withColumn("target", F.when(F.col("target").isNotNull(), key("file", "target"))).withColumn("file", F.lit(parent))
    return Graph(nodes, edges.unionByName(crossing).dropDuplicates(["file", "src", "dst", "edge_type"]), flows)


def expand_star(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(from_file, to_file, name): '*' stands for every name that the target exports."""
    star = imports.where("name = '*'").drop("name").join(exports.select(F.col("file").alias("to_file"), "name"), "to_file")
    return imports.where("name <> '*'").select("from_file", "to_file", "name").union(star.select("from_file", "to_file", "name")).distinct()
