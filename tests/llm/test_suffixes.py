import itertools
import random

import pyarrow as pa

from graphloom.llm.suffixes import KEY, MIN_WORDS, REACH, _neighbours, minimisers, repeated_passages, word_ids


def brute(rows):
    docs = {i: (t or "").encode().lower().split() for i, t in rows if i is not None}
    seen = {}
    for i, w in docs.items():
        for k in range(len(w) - MIN_WORDS + 1):
            seen.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add(i)
    out = {}
    for i, w in docs.items():
        hit = {p for k in range(len(w) - MIN_WORDS + 1) if len(seen[tuple(w[k : k + MIN_WORDS])]) > 1 for p in range(k, k + MIN_WORDS)}
        if hit:
            out[i] = (len(w), len(hit))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, pos int, key string")
    return {r.doc_id: r for r in repeated_passages(df).collect()}


def corpus(rnd):
    text = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 60, 75, 130)]
    rows = [(k, " ".join(text(rnd.randrange(120)) + rnd.choice(shared) + text(rnd.randrange(90)))) for k in range(50)]
    rows += [(60, " ".join(text(80))), (61, rows[0][1]), (62, rows[0][1].upper()), (63, ""), (64, None), (65, "few words"), (65, "few words"), (None, rows[1][1])]
    return rows + [(66, " ".join(["of"] * 300)), (67, " ".join(["of"] * 200 + ["x"])), (68, " ".join(text(3000) + shared[5] + text(3000)))]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        got = run(spark, rows)
        assert {i: (r.n_words, r.n_repeated) for i, r in got.items()} == brute(rows)
        for r in got.values():
            assert r.partner_id != r.doc_id and sum(s.end - s.start for s in r.spans) == r.n_repeated


def test_passage_held_twice_by_one_text(spark):
    rnd = random.Random(5)
    text = lambda n: [f"v{rnd.randrange(90000)}" for _ in range(n)]
    rows = []
    # One text of each pair holds the passage twice; in some pairs it has the smaller key.
    for k, n in enumerate([100, 200, 300, 400, 60] * 4):
        passage = text(n)
        rows += [(2 * k, " ".join(text(20) + passage + text(30) + passage + text(10))), (2 * k + 1, " ".join(text(40) + passage + text(5)))]
    # Of one word: neighbouring suffixes are alike, and their runs are longer than a task.
    rows += [(90, " ".join(["of"] * 3000)), (91, " ".join(["of"] * 700 + text(60) + ["of"] * 900))]
    assert {i: (r.n_words, r.n_repeated) for i, r in run(spark, rows).items()} == brute(rows)


def test_runs_across_task_cuts():
    def batch(rows):
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "ahead", "behind", "text_key", "pos", "hi"])

    word = b"wxyz" * REACH
    rows = [(1, word, word, 5, p, p) for p in (100, 300, 500)] + [(1, word, word, 7, p, p) for p in (40, 900)] + [(2, word, word, 5, 700, 700)]
    whole = {(text, p - REACH, p + KEY + REACH) for k, _, _, text, p, _ in rows if k == 1}
    for cuts in itertools.product((0, 1), repeat=len(rows) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(rows)]
        found = [r for a, b in zip(at, at[1:]) for out in _neighbours([batch(rows[a:b])]) for r in out.to_pylist()]
        edges = sorted((r["key"], r["ahead"], r["behind"], r["text_key"], r["pos"], r["end"]) for r in found if r["edge"])
        found += [r for out in _neighbours([batch(edges)]) for r in out.to_pylist()]
        assert {(r["text_key"], r["start"], r["end"]) for r in found if not r["edge"]} == whole


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_every_passage_keeps_a_suffix_at_the_same_place():
    rnd = random.Random(3)
    passage = [f"p{rnd.randrange(900)}" for _ in range(MIN_WORDS)]
    for _ in range(40):
        left = [f"q{rnd.randrange(900)}" for _ in range(rnd.randrange(70))]
        right = [f"r{rnd.randrange(900)}" for _ in range(rnd.randrange(70))]
        at = minimisers(word_ids(" ".join(left + passage + right).encode())) - len(left)
        own = minimisers(word_ids(" ".join(passage).encode()))
        assert set(own) & set(at) and len(own) == 1
