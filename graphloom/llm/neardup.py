"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

One hash of each shingle fills ``BINS`` bins with their smallest values; an
empty bin copies a bin that a universal hash picks for it (Shrivastava's
optimal densification). Bands of ``ROWS`` bins make buckets. A bucket emits a
star, the edges from one centre to its members, so pairs grow with the members
and not with their square. Every edge is confirmed on the full shingle sets.

A star alone would lose a link between two members of which one fails against
the centre. After the first stars nearly all true members of a bucket are in
one component; buckets of one centre c whose members are in several go on
together, as a group without c. Let D be what c has and a member x lacks, A what
x adds, E both together, and g = 4 |D| + 3 |A|. At 75 % x is linked with c
exactly if g <= |c|, and x with y exactly if

    7 |E_x & E_y| >= g_x + g_y - |c|.

Two members in different components can't both be linked with c, so the right
side is positive: linked ones share differences, at least g_y / 7 of them if y is
linked with c, and at least (g_x - |c|) / 4 if x isn't; and of what x adds, at least
3/4 |x| - |x & c|. So a prefix of E in a common order (what is added first, since that
is rare) makes finer buckets, and two members that meet in none of them aren't linked. Buckets in which the members outside
of the main component times all members are at most ``WORK`` are compared at once, the
others get a centre of their own and so on. Comparing means an upper bound of
|E_x & E_y| by bit maps of ``BITS`` bits: only pairs that pass it are made, and these
are confirmed on the full sets. No pair is dropped by a cap or a sample. The
centre is the member with the most bucket mates. Buckets with the same members
count once.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75^4)^32,
5e-6.

Documents with equal sets are one node. Rows without an id, and rows without
words, are linked with nothing; the former have a null component and are kept.
Repeated rows get the same result. A document is a doc_id: rows that share one
but not a text share a component, with all that any of them is linked with. An
empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import give_back_memory, stash, table

WORDS, BINS, ROWS = 5, 128, 4
#: A link: PER * intersection >= SIMILAR * union.
SIMILAR, PER = 75, 100
BROADCAST_ROWS = 500_000
#: Comparisons that a bucket makes at once, and bits of a member's differences.
WORK, BITS = 1_000_000, 512
#: Bytes of text whose words are hashed at once; words that :class:`WordHashes` remembers.
CHUNK, CACHE_WORDS = 4 << 20, 200_000

_RNG = np.random.default_rng(20240229)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = _RNG.integers(0, BINS, (BINS, 2048), dtype=np.uint8)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_BAND = _RNG.integers(1, 1 << 63, (BINS // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash, remembered by worker."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


_HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings at ``starts`` of ``data``, eight bytes at a time; 8 more bytes than these must be there."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mix(lengths.astype(np.uint64) + _MULTIPLIERS[0])
    todo, at, left = np.arange(len(starts)), starts, lengths
    while len(todo):
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        h[todo] = mix(h[todo] * _MULTIPLIERS[1] + mix((eights[at] & keep) + _MULTIPLIERS[2]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of binary ``texts``, and where each text's words begin and end.

    Arrow's ASCII functions touch just A-Z and split at just the six blanks of the contract.
    """
    # A view: bytes needn't be valid UTF-8.
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").cast(pa.large_binary()).view(pa.large_string())))
    ends = split.offsets.to_numpy()
    words = split.values
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8))) if len(words) else np.zeros(8, np.uint8)
    # Blanks at both ends of a text give empty words.
    full = np.diff(bounds) > 0
    return hashed(bounds[:-1][full], np.diff(bounds)[full], data), np.concatenate(([0], np.cumsum(full)))[ends]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK, "right")))
        # Taken, not sliced: Arrow's text functions gave wrong rows on slices.
        ids, ends = word_hashes(texts.take(pa.array(np.arange(start, stop))))
        start = stop
        last = max(0, len(ids) - WORDS + 1)
        every = ids[:last] * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            every += ids[k : last + k] * _MULTIPLIERS[k]
        every = mix(every)
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
            n = high - low
            if not n:
                yield np.empty(0, np.uint64)
            elif n < WORDS:
                yield mix((ids[low:high] * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                h = np.sort(every[low : high - WORDS + 1])
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingles(text: bytes | None) -> np.ndarray:
    """:func:`shingle_sets` of one text."""
    return next(shingle_sets(pa.array([text], pa.binary())))


def signature(h: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set: the smallest value in each bin, empty bins filled."""
    first = np.searchsorted(h, _EDGES)
    last = np.append(first[1:], len(h))
    full = first < last
    out = h[np.minimum(first, len(h) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        source = np.empty(len(empty), np.intp)
        todo = np.arange(len(empty))
        for width in (0, 16), (16, 256), (256, 2048):
            probes = _PROBES[empty[todo], width[0] : width[1]]
            good = full[probes]
            hit = good.argmax(axis=1)
            found = good[np.arange(len(todo)), hit]
            source[todo[found]] = probes[found, hit[found]]
            todo = todo[~found]
            if not len(todo):
                break
        else:  # practically never; the next full bin is as fixed a choice
            ring = np.flatnonzero(full)
            source[todo] = ring[np.searchsorted(ring, empty[todo]) % len(ring)]
        out[empty] = out[source]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    return mix((sig.reshape(-1, ROWS) * _BAND).sum(axis=1) + np.arange(1, BINS // ROWS + 1, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, buckets) for each row; set_id: 128-bit digest of the set, null if it is empty."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        for batch in batches:
            n, ids, lists = [], [], []
            for h in shingle_sets(batch.column(1)):
                n.append(len(h))
                ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                lists.append(bands(signature(h)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "buckets"])
        give_back_memory()

    return picked.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, set_id binary, buckets array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, h): the full set of each of ``nodes`` (node, rep, set_id), as packed 64-bit hashes; rep: a document that has it."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("binary").alias("t"))
    picked = picked.join(F.broadcast(nodes) if few else nodes, "rep").select("node", "set_id", "t")

    def run(batches):
        for batch in batches:
            node, own = [], []
            for k, set_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2))):
                h = found.tobytes()
                # An id may have other texts, too.
                if hashlib.blake2b(h, digest_size=16).digest() == set_id:
                    node.append(k)
                    own.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own, pa.binary())], ["node", "h"])
        give_back_memory()

    return picked.mapInArrow(run, "node long, h binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, shared, link): what the full sets of each pair share, and whether that makes a link."""
    u = sets.select(F.col("node").alias("u"), F.col("h").alias("hu"))
    v = sets.select(F.col("node").alias("v"), F.col("h").alias("hv"))

    def run(batches):
        for batch in batches:
            shared, link = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                both = np.concatenate((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)))
                both.sort(kind="stable")
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                shared.append(n)
                link.append(PER * n >= SIMILAR * (len(both) - n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(link, pa.bool_())], ["u", "v", "shared", "link"])

    joined = pairs.join(u, "u").join(v, "v").select("u", "v", "hu", "hv")
    return joined.mapInArrow(run, "u long, v long, shared long, link boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges (u, v) with its component's smallest node.

    Alternating large and small stars (Kiveris et al.): about log(n) rounds of
    grouped minima; a hub's edges are pre-aggregated and its joins split.
    """
    edges = stash(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: a node's smaller neighbours, and itself, hang on the smallest of them.
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).union(least.select(F.col("m").alias("u"), F.col("x").alias("v")))
        edges = stash(small.where("u <> v").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).union(roots.select("node", F.col("node").alias("label")))


_RELATED = ["bucket", "key", "node", "n", "deg", "label", "nc", "g", "e", *(f"f{k}" for k in range(BITS // 64))]


def prefix(nc: int, shared: int, n: int) -> int:
    """How many of a member's differences to its centre make buckets, of what is added first and then what is lacking."""
    added, lacking = n - shared, nc - shared
    g = 3 * added + 4 * lacking
    length = added + lacking - (g // 7 + 1 if g <= nc else -((nc - g) // 4)) + 1
    # A linked member shares SIMILAR / PER of n: so many of these at least are what both add.
    both = -(-(SIMILAR * n - PER * shared) // PER)
    return max(0, min(length, added - both + 1) if both > 0 else length)


def differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """How members (key, hub, node, n, deg, label, direct) of groups differ from their centres.

    A row for each bucket that the member goes on in: the group itself where ``direct``, else one for each difference in
    its prefix. nc: the centre's size; g and e: as in the module's text; f: a bit map of the differences.
    """
    u = sets.select(F.col("node").alias("hub"), F.col("h").alias("hu"))
    joined = groups.join(u, "hub").join(sets, "node").select("key", "node", "n", "deg", "label", "direct", "hu", "h")

    def run(batches):
        for batch in batches:
            key, node, n, deg, label, direct = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            for start in range(0, batch.num_rows, 64):
                buckets, counts, numbers, maps = [], [], [], []
                for i in range(start, min(start + 64, batch.num_rows)):
                    c, x = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (6, 7))
                    at = np.searchsorted(c, x)
                    same = c[np.minimum(at, len(c) - 1)] == x
                    lacking = np.ones(len(c), bool)
                    lacking[at[same]] = False
                    # The common order: what is added, then what is lacking, each by hash.
                    differ = np.concatenate((x[~same], c[lacking]))
                    e, g = len(differ), 3 * (len(x) - int(same.sum())) + 4 * int(lacking.sum())
                    flags = np.zeros(BITS, bool)
                    flags[(differ & np.uint64(BITS - 1)).astype(np.intp)] = True
                    if direct[i]:
                        finer = key[i : i + 1]
                    else:
                        with np.errstate(over="ignore"):
                            finer = mix(differ[: prefix(len(c), int(same.sum()), len(x))] ^ mix(key[i : i + 1].view(np.uint64))).view(np.int64)
                    buckets.append(finer)
                    counts.append(len(finer))
                    numbers.append((key[i], node[i], n[i], deg[i], label[i], len(c), g, e))
                    maps.append(np.packbits(flags).view(np.int64))
                rows = np.repeat(np.concatenate((np.array(numbers, np.int64), np.stack(maps)), axis=1), counts, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(rows.shape[1]))], _RELATED)

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in _RELATED))


def can_link(x: str, y: str) -> Column:
    """Whether rows of :func:`differences` of one centre, their columns prefixed by ``x`` and ``y``, may be linked."""
    def only(a: str, b: str) -> Column:
        return functools.reduce(Column.__add__, [F.bit_count(F.col(f"{a}f{k}").bitwiseAND(F.bitwise_not(f"{b}f{k}"))) for k in range(BITS // 64)])

    most = F.least(F.col(f"{x}e") - only(x, y), F.col(f"{y}e") - only(y, x))
    return 7 * most >= F.col(f"{x}g") + F.col(f"{y}g") - F.col(f"{x}nc")


def one_each(members: DataFrame) -> DataFrame:
    """(bucket, size) of the buckets of (bucket, node, label) with several labels; of those with the same members one."""
    found = members.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")
    )
    return found.where("lo < hi").groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """(bucket, size, main, work) of the buckets of (bucket, node, label) with several labels; of those with the same members one.

    main: the most frequent label. work: members outside of it times members.
    """
    counts = members.join(one_each(members), "bucket").groupBy("bucket", "size", "label").agg(F.count("*").alias("c"))
    best = counts.groupBy("bucket", "size").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.max("c").alias("c"))
    return best.select("bucket", "size", "main", ((F.col("size") - F.col("c")) * F.col("size")).alias("work"))


def similar_size(a: str, b: str):
    return F.least(a, b) * PER >= F.greatest(a, b) * SIMILAR


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    assert 7 * SIMILAR == 3 * (PER + SIMILAR), "the bounds of the module's text are those of 75 %"
    rows = stash(sketch(docs, id_col, text_col), "sketch")
    known = rows.where("set_id is not null and doc_id is not null")
    # Every bucket list is a function of the set, so any row of the class serves.
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", "n", F.explode(F.array_distinct("buckets")).alias("bucket")).withColumn("label", F.col("node"))
    buckets = stash(members.join(one_each(members), "bucket").select("bucket", "node", "n", "size"), "buckets")
    mates = buckets.groupBy("node").agg(F.sum("size").alias("deg"))
    large = stash(buckets.join(mates, "node").select("bucket", F.lit(0).cast("long").alias("key"), "node", "n", "deg"), "buckets")
    nodes = buckets.select("node").distinct().join(classes, "node").select("node", "rep", "set_id")
    sets = stash(sets_of(docs, nodes, id_col, text_col).dropDuplicates(["node"]), "sets")
    # Ids with several texts: their nodes are linked from the start.
    torn = known.groupBy("doc_id").agg(F.min(F.xxhash64("set_id")).alias("lo"), F.max(F.xxhash64("set_id")).alias("hi")).where("lo < hi").select("doc_id")
    torn = known.select("doc_id", "set_id").join(torn, "doc_id").distinct().join(classes, "set_id").select("doc_id", "node")
    links = stash(torn.join(torn.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").select("u", F.col("node").alias("v")).where("u < v"), "links")
    labels = links.select(F.col("u").alias("node"), F.col("u").alias("label")) if links.isEmpty() else components(links)
    small, checked = None, []
    while True:
        # One centre for each large bucket.
        hubs = large.groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("deg", -F.col("node"))).alias("c"))
        stars = large.join(hubs.select("bucket", F.col("c.node").alias("hub"), F.col("c.n").alias("nh")), "bucket").where("node <> hub")
        pairs = stars.where(similar_size("nh", "n")).select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v"))
        if small is not None:
            # The small ones at once: members outside of the main component against all that they may be linked with.
            loose = small.where("label <> main").select("bucket", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", *_RELATED[5:])))
            met = small.join(loose, "bucket").where((F.col("label") != F.col("x_label")) & similar_size("n", "x_n") & can_link("x_", ""))
            pairs = pairs.union(met.select(F.least("node", "x_node").alias("u"), F.greatest("node", "x_node").alias("v")))
        pairs = pairs.distinct()
        if checked:
            pairs = pairs.join(functools.reduce(DataFrame.union, checked), ["u", "v"], "left_anti")
        found = stash(confirm(stash(pairs, "pairs"), sets), "confirmed")
        checked.append(found.select("u", "v"))
        new = found.where("link").select("u", "v")
        if not new.isEmpty():
            # The labels stand for all links so far.
            labels = components(links.union(new))
            links = labels.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v"))
        # What is left: starred buckets whose members, without their centre, are in several components.
        rest = stash(stars.select("bucket", "key", "hub", "node", "n", "deg").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "rest")
        rest = rest.join(mixed_buckets(rest).select("bucket"), "bucket")
        # Buckets of one origin and centre are one group. A key names the centres so far, and its members are among
        # those of the key before without the new centre, so the loop ends.
        group = rest.select(F.xxhash64("key", "hub").alias("bucket"), "hub", "node", "n", "deg", "label").distinct()
        group = group.join(mixed_buckets(group), "bucket").select(F.col("bucket").alias("key"), "hub", "node", "n", "deg", "label", (F.col("work") <= WORK).alias("direct"))
        finer = stash(differences(stash(group, "groups"), sets), "differences")
        buckets = stash(finer.join(mixed_buckets(finer), "bucket").withColumn("direct", F.col("work") <= WORK), "buckets")
        if buckets.isEmpty():
            break
        small, large = buckets.where("direct"), buckets.where("not direct").select("bucket", "key", "node", "n", "deg")

    # Components are named by their smallest id.
    linked = stash(labels.join(classes, "node").select("set_id", "label", "rep"), "linked")
    named = linked.join(linked.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("set_id", "component_id")
    named = classes.select("set_id", "rep").join(named, "set_id", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
