import zlib

import numpy as np
import pytest

from graphloom.llm.common import table
from graphloom.llm.quality import THRESHOLD, WIDTH, features, feature_rows, fit, fit_unknown_prior, op9, score, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = [r for r in op9(spark, SF).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if labels[r.doc_id] == 1], [r for r in held if labels[r.doc_id] == 0]
    assert np.mean([r.predicted for r in good]) > 0.95 and np.mean([r.predicted for r in bad]) < 0.25
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD) for r in rows)


def test_hold_out_labels_are_never_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = train(docs, labels), train(docs, flipped)
    assert np.array_equal(a.w1, b.w1) and np.array_equal(a.w2, b.w2)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 1), (5, 0), (7, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a", 9.0), (None, None, 1.0), (4, "good text here", 2.0), (5, "", 3.0), (5, "", 3.0), (7, "x" * 90_000, 4.0)], "doc_id long, text string, score double")
    out = score(docs, train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    none = train(docs, labels.limit(0))
    assert {r.score for r in score(docs, none).collect()} == {1.0}
    assert score(docs.limit(0), none).collect() == []


def test_nonnegative_risk_finds_positives_among_unlabelled():
    rnd = np.random.default_rng(0)
    x = np.zeros((600, WIDTH), np.float32)
    truth = rnd.random(600) < 0.6
    x[:, :4] = rnd.normal(0, 1, (600, 4)) + np.where(truth, 2.0, -2.0)[:, None]
    trusted = truth & (rnd.random(600) < 0.4)
    s = fit(x[trusted], x, 0.6).score(x)
    assert ((s > 0.5) == truth).mean() > 0.95


def test_prior_is_found_without_labels_of_bad_rows():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        truth = rnd.random(3000) < share
        x = np.zeros((3000, WIDTH), np.float32)
        x[:, :4] = rnd.normal(0, 1, (3000, 4)) + np.where(truth, 1.5, -1.5)[:, None]
        trusted = np.zeros((800, WIDTH), np.float32)
        trusted[:, :4] = rnd.normal(1.5, 1, (800, 4))
        model, prior = fit_unknown_prior(trusted, x)
        assert abs(prior - share) < 0.08 and ((model.score(x) > 0.5) == truth).mean() > 0.95


def test_labels_of_bad_documents_are_never_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a, b = train(docs, labels), train(docs, labels.where("quality = 1"))
    assert np.array_equal(a.w1, b.w1)


def test_risk_equals_its_definition():
    """The gradient steps of one epoch lower the non-negative risk, computed here term by term."""
    rnd = np.random.default_rng(2)
    truth = rnd.random(400) < 0.5
    x = np.zeros((400, WIDTH), np.float32)
    x[:, :3] = rnd.normal(0, 1, (400, 3)) + np.where(truth, 1.0, -1.0)[:, None]
    p = x[truth][:100]

    def risk(model):
        fp, fu = model.logit(p), model.logit(x)
        loss = lambda f, y: np.mean([np.log1p(np.exp(-y * v)) for v in f])
        return 0.5 * loss(fp, 1) + max(0.0, loss(fu, -1) - 0.5 * loss(fp, -1))

    flat = fit(p, x, 0.5)
    zero = type(flat)(flat.mean, flat.scale, flat.w1 * 0, flat.b1, flat.w2, np.array(0.0))
    assert risk(flat) < 0.6 * risk(zero)


@pytest.mark.parametrize("text", [None, b"", b"\xff\xfe", b"a", b"\n\n\n", "é".encode() * 9])
def test_features_have_one_shape(text):
    assert features(text).shape == (WIDTH,) and np.isfinite(feature_rows([text])).all()
