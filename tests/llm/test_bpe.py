import random

import numpy as np
import pytest

from graphloom.llm.bpe import Decoder, Encoder, Transducer, default_vocabulary, digest_documents, encode_documents, load_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    path, pattern = default_vocabulary()
    ranks = load_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def samples():
    rnd = random.Random(7)
    yield from ("", " ", "\n\n\n", "a" * 3000, "then" * 900, "😀" * 400, "don't we'll I'M", "x\u0000y", "日本語 текст ñandú")
    for _ in range(400):
        yield "".join(rnd.choice("abcdeinrst  \n'éñ中😀12Ж") for _ in range(rnd.randrange(80)))
    for _ in range(200):
        yield "".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x400, 0xD7FF), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(25))


def test_ids_equal_tiktoken_and_round_trip(codec):
    encoder, decoder, truth = codec
    for text in samples():
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == truth.encode_ordinary(text), text[:40]
        assert b"".join(decoder.stream([ids])) == text.encode()


def test_streaming_decode_gives_whole_characters_in_any_cuts(codec):
    encoder, decoder, _ = codec
    text = "naïve 日本語 😀😀 ok"
    ids = np.frombuffer(encoder.encode(text), "<u4")
    chunks = list(decoder.stream([ids[i : i + 1] for i in range(len(ids))]))
    assert b"".join(chunks) == text.encode()
    for c in chunks:
        c.decode("utf-8")


def test_long_piece_commits_early_and_stays_right(codec):
    encoder, _, truth = codec
    piece = "thandrelyerion" * 60
    assert len(piece) > 3 * Transducer.COMMIT
    assert encoder.transducer.encode(piece.encode()) == truth.encode_ordinary(piece)


def test_documents_with_nulls_repeats_and_clashing_columns(spark, codec):
    encoder, _, truth = codec
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "é" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in digest_documents(docs, *default_vocabulary()).collect())
    assert got == sorted((i or -1, len(truth.encode_ordinary(t or ""))) for i, t, _ in rows)
    full = encode_documents(docs, *default_vocabulary()).collect()
    assert {bytes(r.decoded) for r in full} == {(t or "").encode() for _, t, _ in rows}
    assert digest_documents(docs.limit(0), *default_vocabulary()).collect() == []
