import math
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lattice
from graphloom.llm.lattice import Pieces, default_model, expected, history, learn_kinds, load_pieces, op10, score_documents, spelling

SF = "/root/testdata/sf0.01"


def small():
    pieces = ["▁".encode(), b"a", b"b", b"ab", "▁a".encode(), b"ba", "▁ab".encode()] + [bytes((b,)) for b in range(256) if b not in (97, 98)]
    weight = np.array([1, 5, 4, 3, 2, 2, 1] + [0.01] * 254)
    return Pieces(pieces, np.log(weight / weight.sum()))


def segmentations(v, word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in v.ids:
            for rest in segmentations(v, word[k:]):
                yield [v.ids[word[:k]], *rest]


@pytest.mark.parametrize("word", [b"", b"a", b"ab", b"abab", b"bbab", "é".encode(), b"x"])
def test_sum_over_all_segmentations(word):
    v = small()
    paths = list(segmentations(v, "▁".encode() + word))
    p = [math.exp(v.logp[s].sum()) for s in paths]
    assert math.isclose(spelling(v, [word])[0], math.log(sum(p)), rel_tol=1e-9)
    want = np.zeros(len(v.pieces))
    for s, x in zip(paths, p):
        np.add.at(want, s, x / sum(p))
    assert np.allclose(expected(v, [word]), want)


def test_long_words_take_the_same_sum():
    v = small()
    long = b"ab" * 60
    again = spelling(v, [b"ab", long, b""])
    assert np.isfinite(again).all() and math.isclose(again[1], spelling(v, [long])[0])
    assert np.isclose(expected(v, [long]).sum(), sum(expected(v, [long])))


def test_vocabulary_file_covers_everything():
    v = load_pieces(default_model())
    assert math.isclose(np.exp(v.logp).sum(), 1.0, rel_tol=1e-6)
    assert np.isfinite(spelling(v, ["日本語 😀".encode(), b"\xff\x00", b"word"])).all()


def test_history():
    assert history(np.array([3, 5, 3, 3, 5])).tolist() == [0, 0, 1, 2, 1]


def test_base_counts_and_gain_on_held_out(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train, n = Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(t.encode().lower().split())
            train[None] += 1
    n, v = sum(train.values()), len(train)
    for r in op10(spark, SF).collect():
        ws = texts[r.doc_id].encode().lower().split() + [None]
        base = math.fsum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in train for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_repetition_is_likelier_and_odd_rows_have_scores(spark):
    rows = [(1, "one two three four"), (2, None), (3, ""), (None, "one"), (4, "one one one one"), (4, "one one one one"), (5, "zzqq " * 2000), (6, "q" * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, uid int, word string")
    out = {r.doc_id: r for r in score_documents(docs, docs, default_model()).collect()}
    assert all(math.isfinite(r.score) and r.score < 0 for r in out.values()) and out[2].n_tokens == out[3].n_tokens == 1
    assert out[4].score > out[1].score
    alone = score_documents(docs, docs.limit(0), default_model()).collect()
    assert len(alone) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)
    assert score_documents(docs.limit(0), docs, default_model()).collect() == []


@pytest.mark.parametrize("most", [4, 64])
def test_telling_words_are_exact(spark, monkeypatch, most):
    # Words that are nowhere among the first of a part, and in total among the first of all.
    monkeypatch.setattr(lattice, "FLUSH", 300)
    monkeypatch.setattr(lattice, "TELLING", most)
    rnd = np.random.default_rng(3)
    rows = [" ".join([f"r{k}x{i}" for i in range(120) for _ in range(3)] + [f"w{i}" for i in rnd.integers(0, 90, 200)]) for k in range(40)]
    want = Counter(w for t in rows for w in t.encode().split())
    want = sorted(want, key=lambda w: (-want[w], w))[:most]
    for parts in (1, 5):
        df = spark.createDataFrame([(bytearray(t.encode()),) for t in rows], "t binary").repartition(parts)
        assert list(learn_kinds(df).words) == want
