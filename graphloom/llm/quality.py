"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1. The unlabelled set is drawn from all
documents outside of the hold-out, labelled or not. The class prior is estimated
from the two sets alone, labels of bad documents are never read: a first model
tells positives from unlabelled documents, and the prior is the share of
unlabelled ones among the scores that positives reach (the least ratio of the two
distributions' upper tails; Blanchard et al., Ramaswamy et al.). A small network
then minimises the non-negative unbiased risk (Kiryo et al.) with the logistic
loss, so its sigmoid estimates the probability of a good document.

The fit uses at most ``MAX_SAMPLE`` positives and as many unlabelled documents,
those with the smallest hashes of their ids; every document is scored. Inputs of a
score are the bytes of the whole text and nothing else.

Null text counts as empty. A null id is in no fold's hold-out and never in the
samples. A document labelled both ways is no trusted positive. Rows that repeat an
id count once in a sample, by their smallest text. Without any labelled positive,
as with an empty table, nothing can be learned: every score is 1, so that a filter
keeps all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import give_back_memory, table

MAX_SAMPLE, THRESHOLD, FOLDS, HELD_OUT = 20_000, 0.7, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 48, 60, 512, 3e-3, 1e-3, 11

# Byte classes: each ASCII sign for itself; letters, digits and the rest in groups.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2, 3, 5
_CLASS[:9] = _CLASS[14:32] = 6
_CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
_N_CLASS = 7 + len(_SIGNS)
# Coarse groups for pairs of neighbours: sentence signs, other signs.
_GROUP = _CLASS.copy()
_GROUP[_SIGNS] = 8
_GROUP[[33, 44, 46, 58, 59, 63]] = 7
_N_GROUP = 9
WIDTH = 2 * _N_CLASS + _N_GROUP * _N_GROUP + 8


def features(text: bytes | None) -> np.ndarray:
    """Sign shares and presences, neighbour pairs of byte groups, and shape: lengths, repeats."""
    text = text or b""
    x = np.frombuffer(text, np.uint8)
    n = max(len(x), 1)
    counts = np.bincount(_CLASS[x], minlength=_N_CLASS)
    group = _GROUP[x].astype(np.int64)
    pairs = np.bincount(group[:-1] * _N_GROUP + group[1:], minlength=_N_GROUP * _N_GROUP) if len(x) > 1 else np.zeros(_N_GROUP * _N_GROUP)
    words, lines = text.lower().split(), text.split(b"\n")
    n_words = len(words)
    shape = [
        np.log1p(n_words), np.log1p(len(x)) - np.log1p(n_words), len(set(words)) / max(n_words, 1), len(set(lines)) / len(lines),
        np.log1p(n_words / len(lines)), float(n_words == 0), float(n_words < 8), sum(map(bytes.isalpha, words)) / max(n_words, 1),
    ]
    return np.concatenate((np.sqrt(counts / n), np.log1p(counts) / 8, np.sqrt(pairs / n), shape)).astype(np.float32)


def feature_rows(texts: list) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.empty((0, WIDTH), np.float32)


class Model:
    """One hidden layer over standardised features."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def tail_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An upper bound of the class prior: the least of (share of the unlabelled) / (share of the positives) above a score.

    Only thresholds that three tenths of the positives or more reach are looked at, so that the bound isn't noise.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.7, 91))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    return float(np.clip((above(unlabelled) / np.maximum(above(positive), 1e-9)).min(), 0.02, 0.98))


def fit_unknown_prior(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, float]:
    """The prior by cross-fitting: each half's scores come from a model of the other half."""
    p, u = [], []
    for k in range(2):
        first = fit(positive[k::2], unlabelled[k::2], 0.5)
        p.append(first.logit(positive[1 - k :: 2]))
        u.append(first.logit(unlabelled[1 - k :: 2]))
    prior = tail_ratio(np.concatenate(p), np.concatenate(u))
    return fit(positive, unlabelled, prior), prior


def fit(positive: np.ndarray, x: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Minimise the non-negative PU risk of trusted positives and unlabelled rows ``x``."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    u = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    p = np.clip((positive - mean) / scale, -8, 8).astype(np.float64)
    w = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    sig = lambda f: 1 / (1 + np.exp(-f))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(u))
        for start in range(0, len(u), BATCH):
            bu = u[order[start : start + BATCH]]
            bp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
            z = np.concatenate((bp, bu))
            h = np.tanh(z @ w[0] + w[1])
            f = h @ w[2] + w[3]
            fp, fu = f[: len(bp)], f[len(bp) :]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            # Gradients of the two parts with respect to f.
            dn = np.concatenate((-prior * sig(fp) / len(bp), sig(fu) / len(bu)))
            dp = np.concatenate((-prior * sig(-fp) / len(bp), np.zeros(len(bu))))
            # Below zero the negative part has overfitted: step back along it instead.
            d = dp + dn if negative >= 0 else -dn
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [z.T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], d.sum()]
            t += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, *w)


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Fit on documents outside of the hold-out: at most ``max_sample`` labelled good, and as many of all."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    free = remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    lowest = (F.xxhash64("doc_id"), F.col("doc_id"))
    trusted = good.where(free).orderBy(*lowest).limit(max_sample).select("doc_id", F.lit(True).alias("good"))
    drawn = docs.where(F.col("doc_id").isNotNull() & free).select("doc_id").distinct().orderBy(*lowest).limit(max_sample).select("doc_id", F.lit(False).alias("good"))
    # Two times max_sample rows at most.
    sample = trusted.union(drawn).groupBy("doc_id").agg(F.max("good").alias("good"), F.min("good").alias("both"))
    sample = sample.select("doc_id", "good", (~F.col("both")).alias("drawn"))
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(sample), "doc_id").select("doc_id", "good", "drawn", "t")

    def run(batches):
        for batch in batches:
            packed = [r.tobytes() for r in feature_rows(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["doc_id", "good", "drawn", "x"])

    found = picked.mapInArrow(run, "doc_id long, good boolean, drawn boolean, x binary").groupBy("doc_id", "good", "drawn").agg(F.min("x").alias("x"))
    rows = sorted((r.doc_id, r.good, r.drawn, bytes(r.x)) for r in found.collect())
    x = np.frombuffer(b"".join(r[3] for r in rows), np.float32).reshape(-1, WIDTH)
    positive, unlabelled = x[[r[1] for r in rows]], x[[r[2] for r in rows]]
    if len(positive) < 2 or len(unlabelled) < 2:
        constant = np.zeros(WIDTH)
        return Model(constant, constant + 1, np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), np.array(50.0))
    return fit_unknown_prior(positive, unlabelled)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the ``keep`` columns and the score of every whole text."""
    blob = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(id_col, *keep, F.col(text_col).cast("binary").alias("_text"))
    schema = picked.drop("_text").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = feature_rows(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blob.value.score(x), pa.float64())], [*batch.schema.names[:-1], "score"])
        give_back_memory()

    return picked.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
