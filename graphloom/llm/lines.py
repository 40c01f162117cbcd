"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table sorted by the 128-bit hash of the line's key, with the number
of documents that hold the line and the largest of their ids. Each new batch
adds a run to level 0; when a level holds ``fanout`` runs, they are merged into
one run of the next level, so a line is rewritten about log(batches) times.

Lines are joined with runs by merge joins on the hash: Spark splits a hash
that fills a partition (adaptive skew joins), and counts are combined before
they are shuffled, so one very frequent line costs no single task.

A document is a doc_id: rows that share one count once, and a batch must hold
all rows of its ids. Rows without an id count for nothing and keep all lines.
Null and empty texts are one empty line. Repeated rows each get the same
result; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS, ascii_lower, new_path, stash, table

MIN_CHARS, MIN_DOCS, FANOUT, BATCHES = 20, 3, 4, 4


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (never null) and row_key: what tells rows that share an id apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(h1, h2, doc_id, row_key, pos, batch) of each line whose key is long enough; docs as of :func:`with_row_key`."""
    lines = docs.where("doc_id is not null").select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "row_key", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    )


class LineRuns:
    """The levelled store. Runs are written tables; adding the same batch name again changes nothing."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.added: set[str] = set()

    def _write(self, run: DataFrame) -> DataFrame:
        path = new_path(self.spark, "run")
        run.repartition("h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(run.schema).parquet(path)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        both = functools.reduce(DataFrame.unionByName, runs)
        return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, hashes: DataFrame, batch: str) -> None:
        """Add a batch's lines (h1, h2, doc_id) as a new run; compact the levels that are full."""
        if batch in self.added:
            return
        run = hashes.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        level, run = 0, self._write(run)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            run = self._write(self._merge(self.levels[level]))
            self.levels[level] = []
            level += 1
        self.added.add(batch)

    def state(self) -> DataFrame | None:
        """(h1, h2, n_docs, max_doc) over all runs."""
        runs = [r for level in self.levels for r in level]
        return None if not runs else runs[0] if len(runs) == 1 else self._merge(runs)

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of a new batch whose line no run holds: one merge anti-join per run."""
        for level in self.levels:
            for run in level:
                hashes = hashes.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes


def dropped_lines(hashes: DataFrame, state: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_key, gone): the positions each row loses; the largest id that holds a line keeps it."""
    hot = state.where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc")
    lost = hashes.join(hot.hint("merge"), ["h1", "h2"]).where("doc_id < max_doc")
    return lost.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop the frequent lines of a whole table, fed to the store batch by batch.

    Returns doc_id, the ``keep`` columns, n_lines, n_dropped and kept (the lines
    that stay, joined by a line feed).
    """
    spark = docs.sparkSession
    rows = with_row_key(docs, id_col, text_col)
    hashes = stash(line_hashes(rows, min_chars, batches), "lines", ("batch",))
    store = LineRuns(spark, fanout)
    for b in range(batches):
        store.add(hashes.where(F.col("batch") == b), str(b))
    gone = dropped_lines(hashes, store.state(), min_docs)
    return remove_lines(docs, gone, id_col, text_col, keep)


def remove_lines(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut the positions in ``gone`` (doc_id, row_key, gone) out of the texts."""
    extra = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra).withColumn("row_key", F.xxhash64("text"))
    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "row_key"], "left")
    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return joined.select(
        "doc_id",
        *names,
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("kept"),
    )


def _without(text: Column, gone: Column) -> Column:
    """The text less some of its lines. The outer lambda splits once; array_except hashes, so many lines stay linear."""
    def stay(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda p: F.get(lines, p))

    return F.array_join(F.transform(F.array(F.split(text, "\n")), stay)[0], "\n")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
  ), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), stats AS (
  SELECT k, max(doc_id) AS max_doc FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT y.*, coalesce(y.doc_id < s.max_doc, false) AS gone FROM keyed y LEFT JOIN stats s ON y.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
