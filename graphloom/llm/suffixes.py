"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are kept: of every ``SPREAD`` consecutive five-word
hashes the smallest one's position. Any passage of ``MIN_WORDS`` words holds a
minimiser with at least ``KEY`` more words of the passage behind it, wherever
the passage stands, so equal passages keep suffixes at equal places.

1. Each suffix gives a key, the hash of its first ``KEY`` words. Keys of one
   text only are dropped: what is left is the part of the array in which
   neighbours can agree.
2. The others fetch the words around them and are sorted by what follows
   (a sparse suffix array) and by what precedes (its mirror).
3. Each row is compared with its neighbours of different texts, the last one
   before it and the first one after it: matches are extended left and right,
   and those of ``MIN_WORDS`` or more are passages. Both need no more than a
   minimiser's reach, because the next minimiser carries on.

Sorting is by range over key, context and document, so that a passage that a
third of all rows share is dealt over many tasks; the pairs that a cut between
tasks parts are compared afterwards: a task hands on the rows of the one text
at its start and of the one at its end.

A text is compared once however often it occurs; of a text of ``MIN_WORDS``
words or more that several documents hold, all is repeated. Null text has no
words. Rows without an id are left out. Passages that repeat only within one
text are not reported. Repeated rows of one id count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import stash, table
from graphloom.llm.neardup import _HASHES, mix

MIN_WORDS, GRAM, KEY = 50, 5, 24
SPREAD = MIN_WORDS - KEY + 1
#: Words fetched before a suffix, and behind its key.
REACH = SPREAD
CHUNK = 1 << 20

_RNG = np.random.default_rng(77)
_WEIGHT = _RNG.integers(1, 1 << 63, KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_ids(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, v
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(ids: np.ndarray) -> np.ndarray:
    """Positions of the kept suffixes: those with a whole key behind them in a text long enough."""
    n = len(ids)
    if n < MIN_WORDS:
        return np.empty(0, np.int64)
    h = ids[: n - GRAM + 1] * _WEIGHT[0]
    for k in range(1, GRAM):
        h += ids[k : n - GRAM + 1 + k] * _WEIGHT[k]
    h = mix(h)[: n - KEY + 1]
    found = []
    for start in range(0, len(h) - SPREAD + 1, CHUNK - SPREAD):
        part = h[start : start + CHUNK]
        # The place in the low bits: of equal hashes the first one wins.
        tagged = (part & ~np.uint64(CHUNK - 1)) | np.arange(len(part), dtype=np.uint64)
        found.append(np.unique(_window_min(tagged, SPREAD) & np.uint64(CHUNK - 1)).astype(np.int64) + start)
    return np.unique(np.concatenate(found))


def keys_at(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.empty(0, np.int64)
    return mix((ids[at[:, None] + np.arange(KEY)] * _WEIGHT).sum(axis=1)).view(np.int64)


def suffixes(texts: DataFrame) -> DataFrame:
    """(text_key, pos, key) of every kept suffix; and a row (text_key, -1, number of words) for each text."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                who, pos, key = [], [], []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = word_ids(text)
                    at = minimisers(ids)
                    who.append(np.full(len(at) + 1, k, np.int64))
                    pos.append(np.append(at, -1))
                    key.append(np.append(keys_at(ids, at), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(key))], ["text_key", "pos", "key"])

    return texts.mapInArrow(run, "text_key long, pos int, key long")


def contexts(texts: DataFrame) -> DataFrame:
    """(key, ahead, behind, text_key, pos) for rows (text_key, t, at): the word hashes after the key and, reversed, before it."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                cols: list[list] = [[], [], [], [], []]
                for k, text, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    ids = word_ids(text)
                    small = (ids >> np.uint64(32)).astype(">u4")
                    at = np.array(sorted(at), np.int64)
                    cols[0] += keys_at(ids, at).tolist()
                    cols[1] += [small[p + KEY : p + KEY + REACH].tobytes() for p in at]
                    cols[2] += [small[max(p - REACH, 0) : p][::-1].tobytes() for p in at]
                    cols[3] += [k] * len(at)
                    cols[4] += at.tolist()
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "ahead", "behind", "text_key", "pos"])

    return texts.mapInArrow(run, "key long, ahead binary, behind binary, text_key long, pos int")


def agree(a: bytes, b: bytes) -> int:
    """How many leading words two contexts share."""
    if a == b:
        return len(a) // 4
    x, y = np.frombuffer(a, ">u4"), np.frombuffer(b, ">u4")
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


_FOUND = "edge boolean, key long, ahead binary, behind binary, text_key long, pos int, start int, end int, other long"


def _neighbours(batches):
    """Passages of rows sorted by key: each row against the last one before it and the first one after it of other texts.

    Rows that follow each other in one key and text are a run. Those of a run that have equal contexts and stand at
    most ``MIN_WORDS`` apart are one item (pos to hi): any match of theirs is as long, so their spans join. Edge rows
    are handed on: what the task's first and last run, and their neighbours, may still meet in other tasks.
    """
    names = ["edge", "key", "ahead", "behind", "text_key", "pos", "start", "end", "other"]
    kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    run, other, first = [], None, True  # items of the run; the last item before it of another text; is it the task's first
    out: list = []

    def edge(item):
        out.append((True, *item[:5], None, item[5], None))

    def meet(x, y):
        right, left = KEY + agree(x[1], y[1]), agree(x[2], y[2])
        if left + right >= MIN_WORDS:
            for a, b in ((x, y), (y, x)):
                out.append((False, None, None, None, a[3], None, a[4] - left, a[5] + right, b[3]))

    def close(after):
        """End the run; ``after`` is the row behind it in the same key."""
        for item in run:
            if first:
                edge(item)
            if other is not None:
                meet(other, item)
        if after is not None:
            if first:
                edge(after)
            # The last item is met as the one before the next run.
            for item in run[:-1]:
                meet(item, after)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            last = run[-1] if run else None
            if last is not None and (last[0] != row[0] or last[3] != row[3]):
                same = last[0] == row[0]
                close(row if same else None)
                run, other, first = [], last if same else None, False
            elif last is not None and last[1] == row[1] and last[2] == row[2] and row[4] - last[5] <= MIN_WORDS:
                last[5] = max(last[5], row[5])
                continue
            run.append(list(row))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()
    if run:
        close(None)
        if not first:
            for item in run if other is None else [other, *run]:
                edge(item)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def passages(around: DataFrame) -> DataFrame:
    """(text_key, start, end, other): neighbours' matches in the array sorted by what follows and in its mirror."""
    out = None
    for order in (("key", "ahead", "behind"), ("key", "behind", "ahead")):
        cols = (*order, "text_key", "pos")
        ranged = around.repartitionByRange(*cols).sortWithinPartitions(*cols).select("key", "ahead", "behind", "text_key", "pos", F.col("pos").alias("hi"))
        found = stash(ranged.mapInArrow(_neighbours, _FOUND), "passages")
        # What the cuts between tasks parted: the first and the last run of each task.
        edges = found.where("edge").select("key", "ahead", "behind", "text_key", "pos", F.col("end").alias("hi")).coalesce(1).sortWithinPartitions(*cols)
        both = found.union(edges.mapInArrow(_neighbours, _FOUND)).where("not edge").select("text_key", "start", "end", "other")
        out = both if out is None else out.union(both)
    return out


def merged(spans):
    """The union of sorted (start, end) spans."""
    def fold(acc, s):
        top = F.element_at(acc, -1)
        grown = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(F.size(acc) == 0, F.array(s)).when(top["end"] >= s["start"], F.concat(head, F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), fold)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold repeated passages.

    doc_id, n_words, n_repeated (words in passages), spans (array of start and
    end, in words), partner_id (the smallest id of another document that shares
    one of them, as far as neighbours tell).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    keyed = rows.select("text_key", F.col("text").cast("binary").alias("t"))
    found = stash(suffixes(keyed), "suffixes")
    classes = stash(rows.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "texts")

    kept = found.where("pos >= 0")
    # Written down, so that both sides of the join are dealt out alike and Spark can split a key that fills a task.
    shared = stash(kept.groupBy("key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("key"), "shared")
    at = kept.join(shared, "key").groupBy("text_key").agg(F.collect_set("pos").alias("at"))
    wanted = at.join(classes, "text_key").select("text_key", F.col("rep").alias("doc_id"), "at")
    texts = rows.join(wanted.hint("shuffle_hash"), ["text_key", "doc_id"]).select("text_key", F.col("text").cast("binary").alias("t"), "at").dropDuplicates(["text_key"])
    around = stash(contexts(texts), "contexts")

    lengths = found.where("pos < 0").groupBy("text_key").agg(F.max("key").alias("n_words"))
    spans = passages(around).join(classes.select(F.col("text_key").alias("other"), F.col("rep").alias("partner")), "other")
    spans = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("s"), F.min("partner").alias("partner")).select("text_key", merged(F.col("s")).alias("spans"), "partner")
    per_text = lengths.join(classes, "text_key").join(spans, "text_key", "left")
    copied = (F.col("rep") < F.col("top")) & (F.col("n_words") >= MIN_WORDS)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    per_text = per_text.where(copied | F.col("spans").isNotNull()).select(
        "text_key", "rep", "top", "n_words", F.when(copied, whole).otherwise(F.col("spans")).alias("spans"), "partner", copied.alias("copied")
    )
    own = F.when(F.col("copied"), F.when(F.col("doc_id") == F.col("rep"), F.col("top")).otherwise(F.col("rep")))
    n = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    ids = rows.select("doc_id", "text_key").distinct()
    return ids.join(per_text, "text_key").select("doc_id", "n_words", n.cast("long").alias("n_repeated"), "spans", F.least(own, "partner").alias("partner_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
