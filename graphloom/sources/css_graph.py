"""Style sheets to graph nodes: rules, at-rules, custom properties and their uses, URLs. Expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At-rules by keyword; what they are in the graph.
AT_RULES = {"import": "EXTERNAL", "media": "CONTROL", "supports": "CONTROL", "keyframes": "TRANSFORM", "font-face": "EXTERNAL", "charset": "META", "namespace": "META", "layer": "STRUCTURAL", "container": "CONTROL", "page": "STRUCTURAL"}


def nodes(sheets: DataFrame) -> DataFrame:
    """(file, node_type, node_subtype, label) of (file, source_code)."""
    code = F.regexp_replace("source_code", r"(?s)/\*.*?\*/", "")

    def of(kind: str, subtype: str, pattern: str, group: int = 1):
        return F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(group)), lambda m: F.struct(F.lit(kind).alias("node_type"), F.lit(subtype).alias("node_subtype"), F.trim(m).alias("label")))

    found = [of("STRUCTURAL", "rule", r"(?:^|[{};])\s*([^@{};\s][^{};]*?)\s*\{"), of("EXTERNAL", "url", r"url\(\s*['\"]?([^'\")]+)"), of("STORAGE", "custom_property", r"(--[\w-]+)\s*:"), of("TRANSFORM", "var_reference", r"var\(\s*(--[\w-]+)")]
    found += [of(kind, name.replace("-", "_"), rf"@(?:-\w+-)?{name}\b\s*([^{{;]*)") for name, kind in AT_RULES.items()]
    return sheets.select("file", F.explode(F.concat(*found)).alias("n")).select("file", "n.node_type", "n.node_subtype", "n.label")
