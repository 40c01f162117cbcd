"""Source files in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import language_of

#: Folders and names that a scan leaves out.
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|coverage|vendor|__pycache__|\.next|target)/|\.(test|spec|min|bundle)\.[A-Za-z]+$"
WANTED = r"(?i)\.(js|mjs|cjs|jsx|ts|tsx|py|go|rs|java|php|rb|cs|kt|swift|html?|css)$|(^|/)\.env[^/]*$"


def with_language(files: DataFrame, path: str = "file") -> DataFrame:
    return files.withColumn("language", language_of(F.col(path)))


def scan_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, source_code, language) of every source file below a folder; one row a file, read in parallel."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source_code"))
    return with_language(named.where(F.col("file").rlike(WANTED) & ~F.col("file").rlike(SKIPPED)))


def read_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Weakness descriptions, one JSON document a file; a missing category makes the tier 'quality'."""
    docs = spark.read.option("multiLine", True).json(folder)
    category = F.col("category") if "category" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("tier", F.when(category.isNull(), "quality").otherwise("security"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected results: test_name, category, is_vuln, cwe from a CSV whose comments start with '#'."""
    return spark.read.csv(path, comment="#", schema="test_name string, category string, is_vuln boolean, cwe int")


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def canonical(graph_nodes: DataFrame) -> DataFrame:
    """(file, json): a stable text of a graph's nodes in sequence order, for comparison."""
    row = F.struct("sequence", "id", "label", "node_type", "node_subtype", F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
    return graph_nodes.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_type, node_subtype, n_a, n_b) where two graphs' histograms differ."""
    count = lambda df, n: df.groupBy("node_type", "node_subtype").agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), ["node_type", "node_subtype"], "full").na.fill(0, ["n_a", "n_b"])
    return both.where("n_a <> n_b")


def strip_annotations(code):
    """Type annotations blanked out, every position kept."""
    found = F.regexp_extract_all(code, F.lit(r":\s*[A-Z]\w*(?:<[^<>]*>)?(?:\[\])?(?=\s*[,)=;{])"), F.lit(0))
    return F.aggregate(found, code, lambda acc, m: F.replace(acc, m, F.repeat(F.lit(" "), F.length(m))))
