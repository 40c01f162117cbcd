"""Language-model scores from a subword lattice.

A token's spelling probability is the sum over all its segmentations into the
pieces of an existing vocabulary, by a forward recursion in log space. The
vocabulary's scores give the pieces' first weights; one expectation step over
every distinct training word (forward-backward) re-estimates them. In the
lattice of a text each token has more arcs: the token as a whole, by its
training counts, and the token as one that this text has used before. The text
as a whole first takes one of a few kinds k (found from which frequent words
stand in the same texts; on mixed corpora they come out as the languages), so
its probability is the sum over kinds and segmentations:

    P(text) = sum_k P(k) prod_t P_k(token_t)
    P_k(token_t) = (1 - m) (g_k c_k / N_k + (1 - g_k) (SHARE c / N + (1 - SHARE) spelling_k)) + m used / t
    m = CACHE t / (t + CACHE_AFTER)

g_k is the Good-Turing share of the kind's tokens seen more than once, t the
number of tokens before this one, ``used`` how many of those equal it.

Counts cover all training rows. A head of at most ``HEAD`` frequent words is
broadcast (its size is bounded by a histogram of the counts); the rest, rare by
construction, is joined by shuffle, so no key is hot.

Null text counts as empty: one end token. Every row is scored for itself;
repeated rows each count in training. A null id is not held out. With no
training rows all counts are zero and spelling alone scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import stash, table
from graphloom.llm.quality import remainder

FOLDS, HELD_OUT = 5, 1
HEAD, FLUSH, BATCH, LONG = 100_000, 400_000, 20_000, 48
#: Frequent words that tell kinds of text, the most kinds, and how rarely two kinds' words may meet.
TELLING, KINDS, APART = 64, 4, 0.3
SHARE = 0.3
CACHE, CACHE_AFTER = 0.45, 150.0
MARK = "▁".encode()
ZIPF_SHIFT, SMOOTH = 10.0, 0.1
_B = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: a hash table from piece bytes to ids, and log weights."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.mask = np.uint64((1 << 20) - 1)
        self.keys, self.slots, self.probes = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32), 1
        self.power = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, len(self.power)):
                self.power[k] = self.power[k - 1] * _B
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for b in p:
                    h = h * _B + np.uint64(b + 1)
                at, n = self._slot(h), 1
                while self.slots[at] >= 0:
                    at, n = (at + np.uint64(1)) & self.mask, n + 1
                self.keys[at], self.slots[at], self.probes = h, i, max(self.probes, n)

    def weighted(self, logp: np.ndarray) -> Pieces:
        """The same pieces under other weights; the table is shared."""
        other = object.__new__(Pieces)
        other.__dict__.update(self.__dict__, logp=logp)
        return other

    def _slot(self, h):
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of the hashes, -1 where there is none."""
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        for _ in range(self.probes - 1):
            at = (at + np.uint64(1)) & self.mask
            out = np.where((out < 0) & (self.keys[at] == h), self.slots[at], out)
        return out


def load_pieces(model_path: str) -> Pieces:
    """Pieces of a sentencepiece file and weights from its scores.

    Scores of a merge vocabulary are negative ranks: Zipf's law makes weights of
    them. Scores that are log probabilities (above -50 throughout) are taken as
    they are. Every single byte is a piece, so that nothing is out of reach.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).encode()
            # A mark inside of a piece would reach over a blank, which no word does.
            if MARK not in piece[1:]:
                found.setdefault(piece, sp.get_score(i))
    scores = np.array(list(found.values()))
    logp = scores if scores.min() > -50 else -np.log(ZIPF_SHIFT - scores)
    floor = logp.min() - np.log(10)
    pieces = list(found)
    extra = [bytes((b,)) for b in range(256) if bytes((b,)) not in found]
    if MARK not in found:
        extra.append(MARK)
    logp = np.concatenate((logp, np.full(len(extra), floor)))
    return Pieces(pieces + extra, logp - np.logaddexp.reduce(logp))


def _arcs(vocabulary: Pieces, words: list[bytes]):
    """For words sorted by length: the byte lengths, the longest, and (start, end, rows, piece ids) of every arc by end."""
    n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(size[-1])
    data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T.astype(np.uint64) + np.uint64(1)
    prefix = np.zeros((width + 1, n), np.uint64)
    for j in range(width):
        prefix[j + 1] = prefix[j] * _B + data[j]
    first = np.searchsorted(size, np.arange(width + 1))
    arcs = []
    for j in range(1, width + 1):
        # Shorter words have ended: only the rows from here on.
        lo = int(first[j])
        for i in range(max(0, j - vocabulary.longest), j):
            ids = vocabulary.find(prefix[j, lo:] - prefix[i, lo:] * vocabulary.power[j - i])
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                arcs.append((i, j, rows + lo, ids[rows]))
    return size, width, arcs


def _forward(logp: np.ndarray, n: int, size: np.ndarray, width: int, arcs) -> tuple[np.ndarray, np.ndarray]:
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for i, j, rows, ids in arcs:
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logp[ids])
    return alpha, alpha[size, np.arange(n)]


def _long(vocabulary: Pieces, word: bytes) -> list[tuple[int, int, int]]:
    get, top = vocabulary.ids.get, vocabulary.longest
    return [(i, j, k) for j in range(1, len(word) + 1) for i in range(max(0, j - top), j) if (k := get(word[i:j])) is not None]


def _long_forward(logp: np.ndarray, word: bytes, arcs) -> np.ndarray:
    alpha = np.full(len(word) + 1, -np.inf)
    alpha[0] = 0
    for i, j, k in arcs:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[k])
    return alpha


def _batches(words: list[bytes]):
    """(positions, marked words) sorted by length; long words come alone."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if len(words[i]) <= LONG]
    for start in range(0, len(short), BATCH):
        part = short[start : start + BATCH]
        yield np.array(part), [MARK + words[i] for i in part]
    for i in order[len(short) :]:
        yield np.array([i]), [MARK + words[i]]


def spellings(vocabularies: list[Pieces], words: list[bytes]) -> np.ndarray:
    """(vocabularies, words): log of the summed probability of all segmentations. The vocabularies differ in weights only."""
    out = np.zeros((len(vocabularies), len(words)))
    with np.errstate(over="ignore"):
        for where, part in _batches(words):
            if len(part[0]) > LONG + len(MARK):
                arcs = _long(vocabularies[0], part[0])
                out[:, where] = [[_long_forward(v.logp, part[0], arcs)[-1]] for v in vocabularies]
            else:
                size, width, arcs = _arcs(vocabularies[0], part)
                out[:, where] = [_forward(v.logp, len(part), size, width, arcs)[1] for v in vocabularies]
    return out


def spelling(vocabulary: Pieces, words: list[bytes]) -> np.ndarray:
    return spellings([vocabulary], words)[0]


def expected(vocabulary: Pieces, words: list[bytes]) -> np.ndarray:
    """How often each piece is expected in the words, each word once: forward-backward over the lattice."""
    total = np.zeros(len(vocabulary.pieces))
    logp = vocabulary.logp
    with np.errstate(over="ignore"):
        for _, part in _batches(words):
            if len(part[0]) > LONG + len(MARK):
                arcs = _long(vocabulary, part[0])
                alpha = _long_forward(logp, part[0], arcs)
                beta = np.full(len(alpha), -np.inf)
                beta[-1] = 0
                for i, j, k in reversed(arcs):
                    beta[i] = np.logaddexp(beta[i], beta[j] + logp[k])
                for i, j, k in arcs:
                    total[k] += np.exp(alpha[i] + logp[k] + beta[j] - alpha[-1])
                continue
            size, width, arcs = _arcs(vocabulary, part)
            alpha, full = _forward(logp, len(part), size, width, arcs)
            beta = np.full((width + 1, len(part)), -np.inf)
            beta[size, np.arange(len(part))] = 0
            for i, j, rows, ids in reversed(arcs):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + logp[ids])
            for i, j, rows, ids in arcs:
                total += np.bincount(ids, np.exp(alpha[i, rows] + logp[ids] + beta[j, rows] - full[rows]), len(total))
    return total


def tokens(text: bytes | None) -> list[bytes]:
    """Only A-Z are lower-cased and only the six ASCII blanks split."""
    return (text or b"").lower().split()


class Kinds:
    """A few kinds of text, each a distribution over the telling words."""

    def __init__(self, words: list[bytes], logp: np.ndarray):
        self.words, self.logp = {w: i for i, w in enumerate(words)}, logp

    def of(self, text_tokens: list[bytes]) -> int:
        if len(self.logp) == 1:
            return 0
        found = [i for w in text_tokens if (i := self.words.get(w)) is not None]
        return int(np.argmax(self.logp @ np.bincount(found, minlength=len(self.words)))) if found else 0


def _partial(texts: DataFrame, schema: str, work) -> DataFrame:
    """The Arrow batches of ``work(texts of the task)``."""

    def run(batches):
        yield from work(t for batch in batches for t in batch.column(0).to_pylist())

    return texts.mapInArrow(run, schema)


def _totals(texts: DataFrame, most: int | None) -> DataFrame:
    """(word, c) of all texts. With ``most``: of each ``FLUSH`` distinct words only so many, and as null what each other one has at most."""

    def run(rows):
        def out(counter):
            top = list(counter.items()) if most is None else counter.most_common(most + 1)
            if most is not None and len(top) > most:
                top[most] = (None, top[most][1])
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["word", "c"])

        counter: Counter = Counter()
        for t in rows:
            counter.update(tokens(t))
            if len(counter) > FLUSH:
                yield out(counter)
                counter = Counter()
        yield out(counter)

    return _partial(texts, "word binary, c long", run).groupBy("word").agg(F.sum("c").alias("c"))


def candidates(texts: DataFrame) -> list[bytes]:
    """Words that hold the ``TELLING`` most frequent ones for certain, 16 * TELLING at most.

    The most frequent words of each part give totals that are short by what the parts leave out at most. Only where
    that leaves too many words open are all words counted.
    """
    most = 16 * TELLING
    some = stash(_totals(texts, most), "frequent")
    short = (some.where("word is null").first() or {"c": 0})["c"]
    known = some.where("word is not null").orderBy(F.desc("c"), "word")
    top = known.limit(most + 1).collect()
    least = top[TELLING - 1].c if len(top) >= TELLING else 0
    open_ = [bytes(r.word) for r in top if r.c + short >= least]
    if not short or (short < least and len(open_) <= most):
        return open_[:most]
    return [bytes(r.word) for r in _totals(texts, None).orderBy(F.desc("c"), "word").limit(TELLING).collect()]


def learn_kinds(texts: DataFrame) -> Kinds:
    """Kinds from all texts: the words that are frequent, which of them meet, and anchors that hardly do.

    All counts are exact. Each part of a task sends at most 16 * TELLING words, then each task that many counts squared.
    """
    words = candidates(texts)
    if not words:
        return Kinds([], np.zeros((1, 0)))
    index, m = {w: i for i, w in enumerate(words)}, len(words)

    def meetings(rows):
        total, uses = np.zeros((m, m), np.int64), np.zeros(m, np.int64)
        for t in rows:
            found = [i for w in tokens(t) if (i := index.get(w)) is not None]
            uses += np.bincount(found, minlength=m) if found else 0
            some = np.unique(np.array(found, np.int64))
            total[np.ix_(some, some)] += 1
        i, j = np.nonzero(total)
        own = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, own)), pa.array(np.append(j, np.full(len(own), -1))), pa.array(np.append(total[i, j], uses[own]))], ["i", "j", "n"])

    met, uses = np.zeros((m, m)), np.zeros(m, np.int64)
    for r in _partial(texts, "i long, j long, n long", meetings).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.j < 0:
            uses[r.i] = r.n
        else:
            met[r.i, r.j] = r.n
    order = sorted(range(m), key=lambda i: (-uses[i], words[i]))[:TELLING]
    words, met = [words[i] for i in order], met[np.ix_(order, order)]
    own = np.maximum(met.diagonal(), 1)
    close = met / np.minimum.outer(own, own)
    anchors = [0]
    while len(anchors) < KINDS:
        worst = close[anchors].max(axis=0)
        # The most frequent word that hardly meets any anchor.
        free = np.flatnonzero((worst < APART) & (own > own.max() / 200))
        if not len(free):
            break
        anchors.append(int(free[0]))
    weight = met[anchors] + 0.5
    return Kinds(words, np.log(weight / weight.sum(axis=1, keepdims=True)))


def count_words(texts: DataFrame, kinds: Kinds) -> DataFrame:
    """(word, kind, c) over the binary column ``t``, counted within each task first; a null word counts the texts."""
    blob = texts.sparkSession.sparkContext.broadcast(kinds)

    def run(batches):
        def out(counters):
            flat = [(w, k, c) for k, counter in enumerate(counters) for w, c in counter.items()]
            cols = zip(*flat) if flat else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int32(), pa.int64()))], ["word", "kind", "c"])

        n = len(blob.value.logp)
        counters: list[Counter] = [Counter() for _ in range(n)]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ws = tokens(text)
                counter = counters[blob.value.of(ws)]
                counter.update(ws)
                counter[None] += 1
                if len(counter) > FLUSH:
                    yield out(counters)
                    counters = [Counter() for _ in range(n)]
        yield out(counters)

    return texts.mapInArrow(run, "word binary, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


def reestimate(vocabulary: Pieces, counts: DataFrame, n_kinds: int) -> list[Pieces]:
    """The vocabulary with each kind's weights, from all its distinct words in ``counts`` (word, kind)."""
    blob = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros((n_kinds, len(blob.value.pieces)))
        for batch in batches:
            words, kind = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(n_kinds):
                own = [words[i] for i in np.flatnonzero(kind == k)]
                if own:
                    total[k] += expected(blob.value, own)
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(total[k, piece])], ["kind", "piece", "n"])

    # As many rows as there are pieces and kinds.
    found = counts.select("word", "kind").mapInArrow(run, "kind long, piece long, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).collect()
    weight = np.full((n_kinds, len(vocabulary.pieces)), SMOOTH)
    for r in found:
        weight[r.kind, r.piece] += r.n
    logp = np.log(weight) - np.log(weight.sum(axis=1, keepdims=True))
    # Pieces no word used keep a share by their first weights.
    return [vocabulary.weighted(np.logaddexp(np.log(0.999) + x, np.log(0.001) + vocabulary.logp)) for x in logp]


class Scorer:
    """Turns a token's counts, spelling and place into scores; arrays are (kinds, tokens)."""

    def __init__(self, n: int, v: int, per_kind: np.ndarray, once: np.ndarray, texts: np.ndarray):
        self.n, self.v, self.per_kind = n, v, np.maximum(per_kind, 1)[:, None]
        self.known = np.where(per_kind > 0, np.clip(1 - once / np.maximum(per_kind, 1), 0.01, 0.999), 0.0)[:, None]
        self.prior = np.log10((texts + 1) / (texts.sum() + len(texts)))

    def base(self, c):
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def token(self, c, by_kind, spelled):
        """Probabilities without the text's own history; spelled: natural logs."""
        share = SHARE if self.n else 0.0
        return self.known * by_kind / self.per_kind + (1 - self.known) * (share * c / max(self.n, 1) + (1 - share) * np.exp(spelled))

    @staticmethod
    def cached(n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place t: the share left to the model, and what one earlier use adds."""
        t = np.arange(n, dtype=np.float64)
        m = CACHE * t / (t + CACHE_AFTER)
        return 1 - m, m / np.maximum(t, 1)

    def score(self, p, spelled, keep, gain, used):
        """log10 with the history. ``spelled`` (None: not needed) serves words whose probability is below the smallest double."""
        q = p * keep
        q += gain * used
        if spelled is None or not q.size or q.min() > 1e-300:
            return np.log10(q)
        tiny = (spelled + np.log1p(-self.known) + np.log(1 - SHARE) + np.log(keep)) / np.log(10)
        return np.where(q > 1e-300, np.log10(np.maximum(q, 1e-300)), tiny)


def history(ids: np.ndarray) -> np.ndarray:
    """How often each token's id stands before it."""
    if not len(ids):
        return np.empty(0, np.int64)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - first
    return out


def score_documents(docs: DataFrame, training: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row of ``docs`` by a model learned from ``training``.

    Returns id_col, n_tokens, n_known, train_tokens, base_score and score.
    """
    texts = training.select(F.col(text_col).cast("binary").alias("t"))
    kinds = learn_kinds(texts)
    n_kinds = len(kinds.logp)
    parts = stash(count_words(texts, kinds), "counts")
    by_kind = F.array(*[F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)) for k in range(n_kinds)])
    counts = stash(parts.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"), by_kind.alias("by_kind")), "counts")
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    stats = {r.kind: r for r in parts.groupBy("kind").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))).alias("n"), F.count_if((F.col("c") == 1) & F.col("word").isNotNull()).alias("once"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("texts")).collect()}
    each = lambda name: np.array([(getattr(stats[k], name) or 0) if k in stats else 0 for k in range(n_kinds)], np.float64)
    ends = each("texts")
    scorer = Scorer(seen.n + int(ends.sum()), seen.v + bool(ends.sum()), each("n") + ends, each("once"), ends)
    vocabularies = reestimate(load_pieces(model_path), parts.where("word is not null"), n_kinds)

    # The head: from the most frequent down by bands of counts, as many bands as fit.
    band = F.floor(F.log2("c") * 16).cast("int")
    cut, fill = None, 0
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r.band):
        fill += r["count"]
        if fill > HEAD:
            break
        cut = r.band
    head = {} if cut is None else {bytes(r.word): (r.c, r.by_kind) for r in counts.where(band >= cut).collect()}
    words = sorted(head)
    c = np.array([head[w][0] for w in words], np.float64)
    own = np.array([head[w][1] for w in words], np.float64).reshape(-1, n_kinds).T
    spelled = spellings(vocabularies, words)
    index = {w: i for i, w in enumerate(words)}
    model = docs.sparkSession.sparkContext.broadcast((scorer, vocabularies, index, c, own, spelled, ends))
    names = [id_col, "uid", "n_tokens", "n_known", "base_score", "scores", "word", "t", "used"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.int64(), pa.int64())

    def first(batches):
        scorer, _, index, c, own, spelled, ends = model.value
        p, base, get = scorer.token(c, own, spelled), scorer.base(c), index.get
        end_c, end_own, end_spelled = np.array([ends.sum()]), ends[:, None], np.full((len(ends), 1), -np.log(scorer.n + 1))
        end_p, end_base = scorer.token(end_c, end_own, end_spelled), float(scorer.base(end_c)[0])
        uid = TaskContext.get().taskAttemptId() << 32
        keep, gain = scorer.cached(4096)
        for batch in batches:
            rows, tail = [], []
            for text in batch.column(1).to_pylist():
                uid += 1
                ws = tokens(text)
                n = len(ws)
                if n >= len(keep):
                    keep, gain = scorer.cached(2 * n)
                ids = np.array([get(w, -1) for w in ws], np.int64)
                rare = np.flatnonzero(ids < 0)
                local: dict[bytes, int] = {}
                ids[rare] = [-1 - local.setdefault(ws[i], len(local)) for i in rare.tolist()]
                used = history(ids)
                at = np.flatnonzero(ids >= 0)
                k = ids[at]
                # Words of the head have counts, so their probabilities are far from zero.
                s = scorer.score(p[:, k], None, keep[at], gain[at], used[at]).sum(axis=1)
                s = s + scorer.score(end_p, end_spelled, keep[n : n + 1], gain[n : n + 1], np.zeros(1))[:, 0]
                rows.append((uid, n + 1, len(at) + int(end_c[0] > 0), float(base[k].sum()) + end_base, s.tolist(), None, None, None))
                tail += [(uid, None, None, None, None, ws[i], i, int(used[i])) for i in rare.tolist()]
            ids_ = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(x, y) for x, y in zip(zip(*rows) if rows else [()] * 8, types))], names)
            for start in range(0, len(tail), 50_000):
                part = tail[start : start + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), ids_.type), *(pa.array(x, y) for x, y in zip(zip(*part), types))], names)

    picked = docs.select(id_col, F.col(text_col).cast("binary").alias("_t"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, uid long, n_tokens long, n_known long, base_score double, scores array<double>, word binary, t long, used long"
    scored = stash(picked.mapInArrow(first, schema), "scores")
    sums = ", ".join(f"s{k} double" for k in range(n_kinds))

    def rest(batches):
        scorer, vocabularies, *_ = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(1).dictionary_encode()
            where, kept = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
            s = spellings(vocabularies, kept)[:, where]
            t, used, c = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3, 4))
            own = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(vocabularies)).T
            m = CACHE * t / (t + CACHE_AFTER)
            out = scorer.score(scorer.token(c, own, s), s, 1 - m, m / np.maximum(t, 1), used)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c > 0).astype(np.int64)), pa.array(scorer.base(c)), *map(pa.array, out)], ["uid", "k", "b", *(f"s{k}" for k in range(len(out)))])

    none = F.array_repeat(F.lit(0).cast("long"), n_kinds)
    tail = scored.where("word is not null").join(counts, "word", "left").select("uid", "word", "t", "used", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("by_kind", none).alias("by_kind"))
    tail = tail.mapInArrow(rest, f"uid long, k long, b double, {sums}").groupBy("uid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(n_kinds)])
    plus = lambda a, b: (F.col(a) if isinstance(a, str) else a) + F.coalesce(b, F.lit(0))
    paths = [plus(F.col("scores")[k], f"s{k}") + float(scorer.prior[k]) for k in range(n_kinds)]
    best = F.greatest(*paths) if n_kinds > 1 else paths[0]
    total = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in paths), F.lit(0.0)))
    return scored.where("word is null").join(tail, "uid", "left").select(
        id_col, "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"), plus("base_score", "b").alias("base_score"), total.alias("score")
    )


def default_model() -> str:
    import public_tokenizers as tokenizers

    return tokenizers.path("piece_bpe_32k.model")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = score_documents(docs, docs.where(~held), default_model())
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
