"""Benchmark decontamination over a positional inverted index. DataFrame functions only.

The index holds a row (term, document, position) for every training token whose
term the test set uses, stored in term order per segment. A query picks the
rarest terms of each test window by their counts in the index, shifts their
posting lists by the terms' offsets in the item and intersects them: what is
left names a document, an item and a diagonal (document position less item
position). Candidates are then compared word by word with the document.

Only data whose size was counted first are broadcast, and there is a shuffled
way beyond ``BROADCAST_ROWS``. A document is a row; rows that share id and text
share a key and get the same result. Null text has no words. A null item_id
hits words, but can't be listed. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, stash, table

#: Words of the query's contract, A-Z not yet lower-cased. Naming the members is 2.5 times as fast as naming the others.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: The term of a document's end, whose position is its number of words: what xxhash64 makes of null.
END = 42
WINDOW = 10
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, item_key, iw (its words), len (words in a window) of the items that have words."""
    items = benchmark.select(F.col(id_col).alias("item_id"), lower_words(F.col(text_col)).alias("iw")).where(F.size("iw") > 0)
    return items.select("item_id", F.xxhash64("item_id", "iw").alias("item_key"), "iw", F.least(F.size("iw"), F.lit(window)).alias("len")).distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings (term, doc_id, row_key, pos), stored in term order per segment.

    docs: as of :func:`documents_of`. terms: a table with the column ``term``
    (a term's 64-bit hash); with it the index holds those terms only. Every
    document row adds one posting of the term ``END``.
    """
    marked = F.concat(words(F.col("text")), F.array(F.lit(None).cast("string")))
    tokens = docs.select("doc_id", "row_key", F.posexplode(marked).alias("pos", "word"))
    postings = tokens.select(F.xxhash64(ascii_lower(F.col("word"))).alias("term"), "doc_id", "row_key", "pos")
    if terms is not None:
        ends = docs.sparkSession.range(1).select(F.lit(END).cast("long").alias("term"))
        postings = postings.join(sized(terms.union(ends)), "term", "left_semi")
    return stash(postings.sortWithinPartitions("term"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_key, q, term): every word of every item with its position."""
    return items.select("item_key", F.posexplode("iw").alias("q", "word")).select("item_key", "q", F.xxhash64("word").alias("term"))


def rarest(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_key, s, a, b, term_a, term_b): the two rarest words of each window that can occur at all.

    s: the window's start; a, b: the words' positions in the item (equal in a window of one word).
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    starts = items.select("item_key", "iw", "len", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("len"))).alias("s"))
    places = starts.select("item_key", "s", F.posexplode(F.slice(F.col("iw"), F.col("s") + 1, F.col("len"))).alias("k", "word"))
    places = places.select("item_key", "s", (F.col("s") + F.col("k")).alias("q"), F.xxhash64("word").alias("term"))
    ranked = (
        places.join(counts, "term", "left")
        .groupBy("item_key", "s")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "term"))), 1, 2).alias("two"))
    )
    a, b = F.col("two")[0], F.get("two", F.size("two") - 1)
    return ranked.where(a["n"] > 0).select("item_key", "s", a["q"].alias("a"), b["q"].alias("b"), a["term"].alias("term_a"), b["term"].alias("term_b"))


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_key, diagonal) where the two rarest words of a window stand in their places."""
    ends = anchors.select("item_key", F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("term_a").alias("term")), F.struct(F.col("b").alias("q"), F.col("term_b").alias("term")))).alias("e"))
    ends = ends.select("item_key", "e.q", "e.term").distinct()
    pairs = anchors.groupBy("item_key").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    shifted = index.join(sized(ends), "term").select("doc_id", "row_key", "item_key", (F.col("pos") - F.col("q")).alias("diagonal"), "q")
    met = shifted.groupBy("doc_id", "row_key", "item_key", "diagonal").agg(F.collect_set("q").alias("qs"))
    both = F.exists("pairs", lambda p: F.array_contains("qs", p["a"]) & F.array_contains("qs", p["b"]))
    return met.join(sized(pairs), "item_key").where(both).select("doc_id", "row_key", "item_key", "diagonal")


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, row_key, found): for the documents with exact matches, (item_id, positions hit) of each.

    A window that occurs hits all its words. Only candidates' texts are read.
    """
    at = candidates(index, rarest(items, index)).join(sized(items), "item_key")
    per_doc = at.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("item_id", "iw", "len", "diagonal")).alias("cands"))
    per_doc = stash(per_doc.select(F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key"), "cands"), "candidates")
    rows = docs.join(sized(per_doc, BROADCAST_ROWS // 10), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_key") == F.col("c_key")))

    def hits(ws: Column) -> Column:
        def of(c: Column) -> Column:
            at = c["diagonal"]
            starts = F.sequence(F.lit(0), F.size(c["iw"]) - c["len"])
            same = lambda s: (at + s >= 0) & (F.slice(ws, F.greatest(at + s, F.lit(0)) + 1, c["len"]) == F.slice(c["iw"], s + 1, c["len"]))
            spans = F.transform(F.filter(starts, same), lambda s: F.sequence(at + s, at + s + c["len"] - 1))
            return F.struct(c["item_id"].alias("item_id"), F.array_distinct(F.flatten(spans)).alias("hit"))

        return F.filter(F.transform("cands", of), lambda m: F.size(m["hit"]) > 0)

    # The outer lambda makes a document's words once.
    exact = F.transform(F.array(lower_words(F.col("text"))), hits)[0]
    return rows.select("doc_id", "row_key", exact.alias("found")).where(F.size("found") > 0).dropDuplicates(["doc_id", "row_key"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: doc_id, row_key (hash of its text), n_words, n_hit, n_items, item_ids (sorted strings), contaminated."""
    rows, items = documents_of(docs, id_col, text_col), items_of(benchmark, item_id, item_text, window)
    index = build_index(rows, item_terms(items).select("term").distinct())
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["item_id"].cast("string"))))
    hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda m: m["hit"]))))
    matched = phrase_matches(rows, items, index).select(
        F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), hit.cast("long").alias("n_hit"), F.filter(ids, lambda x: x.isNotNull()).alias("item_ids")
    )
    ends = index.where(F.col("term") == END).select("doc_id", "row_key", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_key") == F.col("m_key")), "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))
    return out.select("doc_id", "row_key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(item_id, doc_id, start, end): the items' distinct words all within ``slop`` positions, in any order.

    Lists are joined from each item's rarest word on, by position block, so
    that no document's postings are paired with each other as a whole.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = item_terms(items).select("item_key", "term").distinct().join(counts, "term", "left")
    need = terms.groupBy("item_key").agg(F.count("*").alias("n_terms"), F.min(F.struct(F.coalesce("n", F.lit(0)), "term"))["term"].alias("rare"))
    anchor = index.join(need, F.col("term") == F.col("rare")).select("item_key", "n_terms", "doc_id", "row_key", F.col("pos").alias("at"))
    anchor = anchor.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - slop) / slop), F.floor((F.col("at") + slop) / slop))))
    others = index.join(terms.select("item_key", "term"), "term").withColumn("block", F.floor(F.col("pos") / slop))
    near = anchor.join(others, ["item_key", "doc_id", "row_key", "block"]).where(F.abs(F.col("pos") - F.col("at")) < slop)
    # Every window of slop positions that holds the anchor starts at one of the words near it.
    starts = near.select("item_key", "n_terms", "doc_id", "row_key", "at", F.col("pos").alias("start")).where("start <= at").distinct()
    inside = starts.join(near, ["item_key", "n_terms", "doc_id", "row_key", "at"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + slop))
    full = inside.groupBy("item_key", "n_terms", "doc_id", "row_key", "at", "start", "term").agg(F.min("pos").alias("pos"))
    full = full.groupBy("item_key", "n_terms", "doc_id", "start").agg(F.countDistinct("term").alias("n"), F.max("pos").alias("end")).where("n = n_terms")
    return full.join(items.select("item_key", "item_id"), "item_key").select("item_id", "doc_id", "start", "end")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
), iw AS (
  SELECT item_id, least(len(w), {WINDOW}) AS l, w[s + 1 : s + least(len(w), {WINDOW})] AS win
  FROM i, LATERAL (SELECT unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT l FROM iw),
dw AS (
  SELECT doc_id, l, s, w[s + 1 : s + l] AS win
  FROM d, lens, LATERAL (SELECT unnest(range(0, len(w) - l + 1)) AS s) WHERE len(w) >= l
), m AS (
  SELECT DISTINCT doc_id, dw.l, s, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM m, LATERAL (SELECT unnest(range(s, s + l)) AS p) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS j FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.j, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
