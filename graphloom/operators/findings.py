"""Result algebra: dedup, composition, ranking, scoring."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions.classify import missing_category, severity_rank
from graphloom.storage import settle

# Families of weaknesses, parent to members.
FAMILIES = {
    22: [*range(23, 41), 56, 66, 67, 69, 72, 73],
    59: [61, 62, 64, 65],
    79: list(range(80, 88)),
    75: [76, 138, *range(140, 154), 692],
    20: list(range(228, 241)),
    790: list(range(791, 798)),
}
WRITES = ("db_write", "file_write", "env_write", "cache_write", "state_write", "log_write")


def _number(cwe):
    return F.regexp_extract(cwe, r"(\d+)", 1).try_cast("int")


def dedup(findings: DataFrame) -> DataFrame:
    """Per (file, cwe, source, sink, missing category) the most severe finding, then the first; EFFECTIVE_CONTROL is exempt.

    findings: file, ord, cwe, source, sink, missing, severity.
    """
    tagged = findings.withColumn("category", missing_category(F.col("missing")))
    w = Window.partitionBy("file", "cwe", "source", "sink", "category").orderBy(severity_rank(F.col("severity")).desc(), "ord")
    kept = tagged.withColumn("rn", F.row_number().over(w)).where("rn = 1 or category = 'EFFECTIVE_CONTROL'")
    return kept.drop("rn", "category")


def family_dedup(findings: DataFrame) -> DataFrame:
    """Where several members of a family hit the same evidence, the parent stays, else the most severe, else the lowest number.

    Adds collapsed_cwes: the losers, sorted, comma-joined.
    """
    pairs = [(f"CWE-{m}", f"CWE-{p}") for p, members in FAMILIES.items() for m in [p, *members]]
    family = F.broadcast(findings.sparkSession.createDataFrame(pairs, "cwe string, family string"))
    tagged = findings.join(family, "cwe", "left").withColumn("category", missing_category(F.col("missing")))
    group = F.when(F.col("family").isNotNull() & (F.col("category") != "EFFECTIVE_CONTROL"), F.concat_ws("::", "family", "source", "sink", "category")).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    tagged = tagged.withColumn("grp", group)
    every = Window.partitionBy("file", "grp")
    order = every.orderBy((F.col("cwe") != F.col("family")).cast("int"), severity_rank(F.col("severity")).desc(), _number(F.col("cwe")), "ord")
    tagged = tagged.withColumn("cwes", F.array_sort(F.collect_set("cwe").over(every))).withColumn("rn", F.row_number().over(order))
    alone = F.col("grp").startswith("#")
    kept = tagged.where(alone | F.expr("size(cwes) = 1 or rn = 1"))
    losers = F.when(~alone & (F.size("cwes") > 1), F.array_join(F.filter("cwes", lambda c: c != F.col("cwe")), ",")).otherwise("")
    return kept.select(*findings.columns, losers.alias("collapsed_cwes"))


def compose(findings: DataFrame) -> DataFrame:
    """Chains of two findings over a shared storage target, or over a shared node of one file.

    findings: ord, file, cwe, source, sink, severity, sink_kind, sink_name, source_kind,
    source_name, sink_boundary, source_boundary, sink_type, sink_subtype, source_type,
    source_subtype. Joins on the bridge replace the all-pairs loop; one chain per
    unordered pair, the first in (a, b) order; two reads make no chain.

    A pair is named by its findings' file:source->sink. Where such a name stands for one
    finding, the only other chain of its pair is the reverse one, and the joined row tells
    whether that exists: these rows are neither shuffled nor sorted. Only pairs with a
    finding whose name is ``odd`` (held by several, null, or with a "|") are grouped by name.
    """
    name = F.concat("file", F.lit(":"), "source", F.lit("->"), "sink")

    def writes(kind: str, sub: str):
        return F.coalesce(F.col(sub).isin(*WRITES) | (F.col(kind).isin("EGRESS", "STORAGE") & (F.col(sub) != "http_request")), F.lit(False))

    rows = findings.select(
        "ord", "file", "source", "sink", "sink_kind", "sink_name", "source_kind", "source_name", "sink_boundary", "source_boundary",
        severity_rank(F.col("severity")).alias("rank"), writes("sink_type", "sink_subtype").alias("sink_writes"), writes("source_type", "source_subtype").alias("source_writes"),
    )
    names = findings.groupBy(F.xxhash64(name).alias("h")).agg(F.count("*").alias("n"), F.max(F.coalesce(F.contains(name, F.lit("|")), F.lit(True))).alias("bad"))
    odd = settle(names.where("n > 1 or bad").select("h"), "odd_names")
    if odd.isEmpty():
        return _chains(rows, rows).where(_first_of_two()).select(*_chain())
    plain, other = (rows.withColumn("h", F.xxhash64(name)).join(odd, "h", kind).drop("h") for kind in ("left_anti", "left_semi"))
    ida, idb = (F.concat(F.col(f"{s}_file"), F.lit(":"), F.col(f"{s}_source"), F.lit("->"), F.col(f"{s}_sink")) for s in "ab")
    both = _chains(other, rows).union(_chains(plain, other)).select(*_chain(), F.concat_ws("||", F.least(ida, idb), F.greatest(ida, idb)).alias("pair"))
    w = Window.partitionBy("pair").orderBy("first", "second")
    grouped = both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pair")
    return _chains(plain, plain).where(_first_of_two()).select(*_chain()).union(grouped)


def _meets(x: str, y: str):
    return F.coalesce((F.col(f"{x}_sink_kind") == F.col(f"{y}_source_kind")) & (F.col(f"{x}_sink_name") == F.col(f"{y}_source_name")), F.lit(False))


def _chains(first: DataFrame, second: DataFrame) -> DataFrame:
    """All chains of a finding of ``first`` (columns a_*) and one of ``second`` (columns b_*), with chain_type."""
    a, b = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s, df in (("a", first), ("b", second)))
    stored = a.join(b, (F.col("a_sink_kind") == F.col("b_source_kind")) & (F.col("a_sink_name") == F.col("b_source_name"))).where("a_ord <> b_ord and (a_sink_writes or b_source_writes)")
    stored = stored.withColumn("chain_type", F.when(F.col("a_sink_kind") == "file", "file_bridge").when(F.col("a_sink_kind") == "env", "env_bridge").otherwise("storage_bridge"))
    # A pair whose targets meet but which is read only is no same-node chain either.
    same = a.join(b, (F.col("a_file") == F.col("b_file")) & (F.col("a_sink") == F.col("b_source"))).where("a_ord <> b_ord").where(~_meets("a", "b"))
    return stored.unionByName(same.withColumn("chain_type", F.lit("same_node")))


def _first_of_two():
    """Whether a row of :func:`_chains` comes before the chain of b and a, or there is none."""
    same = F.coalesce((F.col("b_file") == F.col("a_file")) & (F.col("b_sink") == F.col("a_source")), F.lit(False))
    reverse = F.when(_meets("b", "a"), F.col("b_sink_writes") | F.col("a_source_writes")).otherwise(same)
    return (F.col("a_ord") < F.col("b_ord")) | ~reverse


def _chain() -> list[Column]:
    """The columns of a chain, of a row of :func:`_chains`."""
    ends = [F.col(c) for c in ("a_sink_boundary", "a_source_boundary", "b_sink_boundary", "b_source_boundary")]
    # As boundaries_crossed, without making an array for each row.
    fresh = [functools.reduce(Column.__and__, [~x.eqNullSafe(y) for y in ends[:k]], F.coalesce(x != "", F.lit(False))).cast("int") for k, x in enumerate(ends)]
    crossed = F.greatest(functools.reduce(Column.__add__, fresh) - 1, F.lit(0))
    rank = F.least(F.greatest("a_rank", "b_rank") + 1, F.lit(4))
    return [
        F.col("a_ord").alias("first"), F.col("b_ord").alias("second"), F.col("chain_type"),
        F.when(F.col("chain_type") == "same_node", 0).otherwise(crossed).cast("int").alias("boundaries"),
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), rank).alias("severity"),
    ]


def score(labelled: DataFrame, group: str) -> DataFrame:
    """Confusion counts, rates and score (TPR - FPR) per group, with a total row (null group).

    labelled: group, truth, predicted (booleans).
    """
    t, p = F.col("truth"), F.col("predicted")
    counts = labelled.rollup(group).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tpr, fpr = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return counts.select(group, "tp", "fp", "tn", "fn", F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), F.round(tpr - fpr, 6).alias("score"))


def top_rules(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent weaknesses; ties by number."""
    return findings.groupBy("cwe").agg(F.count("*").alias("n")).orderBy(F.desc("n"), _number(F.col("cwe"))).limit(k)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("cwe").alias("n_cwes"))


def majority_language(nodes: DataFrame) -> DataFrame:
    """(file, language): the most frequent one, of ties the one seen first."""
    counts = nodes.where("language is not null and language <> ''").groupBy("file", "language").agg(F.count("*").alias("n"), F.min("sequence").alias("first"))
    return counts.groupBy("file").agg(F.min_by("language", F.struct(-F.col("n"), "first", "language")).alias("language"))


def by_endpoint(findings: DataFrame, path: str = "path") -> DataFrame:
    return findings.groupBy(F.coalesce(F.col(path), F.lit("_no_path")).alias("endpoint")).agg(F.count("*").alias("n"))


def report(findings: DataFrame) -> DataFrame:
    """One text line per finding, most severe first."""
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "cwe", F.lit(" "), "source", F.lit(" -> "), "sink", F.lit(": missing "), "missing")
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "ord").select("ord", line.alias("line"))


def strength_after_run(findings: DataFrame) -> DataFrame:
    """A certificate's strength after an observation: confirmed is conclusive, refuted is refuted."""
    return findings.withColumn("strength", F.when(F.col("observed") == "confirmed", "conclusive").when(F.col("observed") == "refuted", "refuted").otherwise(F.col("strength")))
