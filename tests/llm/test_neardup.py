import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import neardup
from graphloom.llm.neardup import BINS, near_duplicates, shingles, signature


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, bucket long")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())


def corpus(rnd):
    rows, k = [], 0
    for family in range(14):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 5, 6, 9, 60, 200]))]
        for copy in range(rnd.choice([1, 2, 3, 14])):
            text = [f"n{rnd.randrange(9999)}" if rnd.random() < rnd.choice([0, 0.005, 0.02, 0.04, 0.08]) else w for w in base]
            rows.append((k, "  ".join(text).upper() if rnd.random() < 0.2 else " ".join(text)))
            k += 1
    return rows + [(k, ""), (k + 1, None), (k + 2, " \n\t"), (k + 3, "One"), (k + 4, "one"), (k + 5, "ÉTÉ"), (k + 6, "été")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        assert run(spark, rows) == brute(rows)


def test_large_bucket_is_dealt_finer(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WORK", 8)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(4000)}" for _ in range(150)]
    rows = [(k, " ".join(f"n{rnd.randrange(99999)}" if rnd.random() < rnd.choice([0.01, 0.03, 0.05, 0.07]) else w for w in base)) for k in range(60)]
    # Copies of a far copy: linked with each other, but not with the original.
    far = [f"m{rnd.randrange(9999)}" if rnd.random() < 0.07 else w for w in base]
    rows += [(100 + k, " ".join(f"o{rnd.randrange(99999)}" if rnd.random() < 0.02 else w for w in far)) for k in range(12)]
    # Cut and grown copies: what they lack, or add, is all that sets them apart.
    rows += [(200 + k, " ".join(base[rnd.randrange(30) : 150 - rnd.randrange(30)])) for k in range(20)]
    rows += [(300 + k, " ".join(base + [f"p{rnd.randrange(60)}" for _ in range(rnd.randrange(60))])) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_bounds_keep_every_link():
    """Two members that are linked, but not both with the centre, share a prefix element and pass the bit maps."""
    rnd = np.random.default_rng(3)
    pool, met = rnd.integers(0, 1 << 63, 400, dtype=np.uint64), 0
    for _ in range(3000):
        c = rnd.choice(pool, 60, replace=False)
        near = rnd.choice(pool, 8, replace=False)
        x, y = (np.union1d(c[rnd.random(60) > rnd.choice([0.02, 0.1, 0.2])], near[rnd.random(8) < 0.7]) for _ in range(2))
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        parts = []
        for z in (x, y):
            added, lacking = np.setdiff1d(z, c), np.setdiff1d(c, z)
            g, differ = 3 * len(added) + 4 * len(lacking), [*added, *lacking]
            linked = 100 * len(np.intersect1d(z, c)) >= 75 * len(np.union1d(z, c))
            assert linked == (g <= len(c))
            parts.append((linked, g, set(differ), set(differ[: neardup.prefix(len(c), len(z) - len(added), len(z))])))
        if parts[0][0] and parts[1][0]:
            continue
        met += 1
        assert parts[0][3] & parts[1][3]
        assert 7 * len(parts[0][2] & parts[1][2]) >= parts[0][1] + parts[1][1] - len(c)
    assert met > 20


def test_thousands_of_edited_copies_make_few_pairs(spark, monkeypatch):
    made, stash = [], neardup.stash
    monkeypatch.setattr(neardup, "stash", lambda df, label, *a: made.append((label, out := stash(df, label, *a))) or out)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(4000)}" for _ in range(120)]
    rows = [(k, " ".join(f"n{rnd.randrange(99999)}" if rnd.random() < k % 10 / 100 else w for w in base)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs).count() == 1500
    assert sum(df.count() for label, df in made if label == "pairs") < 20 * 1500


def test_rows_that_share_an_id_share_a_component(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (9, "u v w x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_repeated_rows_nulls_and_empty_tables(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(2, t), (2, t), (1, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True), (None, None, True)], key=repr)
    assert near_duplicates(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_shingles_and_signature(numbers):
    words = [f"w{k}" for k in numbers]
    h = shingles(" ".join(words).encode())
    assert len(h) == len({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}) if words else not len(h)
    if words:
        s = signature(h)
        assert len(s) == BINS and np.isin(s, h).all()


def test_signature_agrees_as_often_as_sets_do():
    rnd = np.random.default_rng(4)
    for n in (4, 40, 4000):
        share = []
        for _ in range(60):
            h = np.unique(rnd.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(rnd.permutation(h)[:n]), h
            share.append((signature(a) == signature(b)).mean())
        assert abs(np.mean(share) - 0.8) < 0.05


def test_sets_of_many_texts_at_once(monkeypatch):
    parts = [b"A", b"b", b"\xc3\x89", b" ", b" ", b"\t", b"\n", b"\x0b", b"\x1c", b"\xc2\xa0", b"\x00", b"\xff", b"longerthaneight", b"Z"]
    r = random.Random(5)
    texts = [None if r.random() < 0.1 else b"".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(300)]
    names, values = {}, {}
    for chunk in (1, 500, 1 << 20):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        got = list(neardup.shingle_sets(pa.array([b"x", *texts], pa.binary()).slice(1)))
        assert len(got) == len(texts)
        for text, h in zip(texts, got):
            words = (text or b"").lower().split()
            want = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            assert len(h) == len(want) and sorted(set(h.tolist())) == h.tolist()
            # One set of hashes for one set of shingles, and the other way round.
            key = frozenset(want)
            assert names.setdefault(key, h.tobytes()) == h.tobytes() and values.setdefault(h.tobytes(), key) == key
