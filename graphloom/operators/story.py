"""Ordered folds over a story: rows (file, ord, variable, taint_class, node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Classes by their place among sentences of one line.
PRIORITY = {"TAINTED": 0, "TRANSFORM": 1, "NEUTRAL": 2, "SAFE": 3, "STRUCTURAL": 4, "SINK": 5}


def ordered(sentences: DataFrame) -> DataFrame:
    """Sentences (file, line, taint_class, seq, ...) with ``ord``: by line, class priority, then sequence."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("taint_class")), F.lit(9))
    return sentences.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("line", rank, "seq")))


def last_state(story: DataFrame) -> DataFrame:
    """Each row with the state its variable has by then: the class and node of the last TAINTED or SAFE row."""
    w = Window.partitionBy("file", "variable").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.when(F.col("taint_class").isin("TAINTED", "SAFE"), F.struct(F.col("taint_class").alias("state"), F.col("node_id").alias("origin")))
    return story.withColumn("now", F.last(sets, ignorenulls=True).over(w))


def tainted_at_sinks(story: DataFrame) -> DataFrame:
    """The sink rows whose variable is tainted, with the node that tainted it."""
    named = last_state(story.where("variable <> ''"))
    return named.where("taint_class = 'SINK' and now.state = 'TAINTED'").select("file", "node_id", "variable", F.col("now.origin").alias("origin"))
