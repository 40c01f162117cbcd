import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS
from graphloom.llm.lines import LineRuns, dedup_lines, line_hashes, with_row_key

SCHEMA = "doc_id long, text string, h1 string, batch int, kept string"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[lower(line.strip(BLANKS))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(k := lower(x.strip(BLANKS))) >= 20 and len(h := holders[k] - {None}) >= 3 and i < max(h) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(df, **kw).collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = ["A shared line of some LENGTH %d" % k for k in range(12)] + ["short", "", "   ", "ÄÖÜ is twenty characters é", "\ta shared line of some length 1 \r"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for k in range(40)]
    rows += [(3, rows[3][1]), (None, pool[0]), (None, None), (50, None), (51, ""), (52, "\n".join([pool[1]] * 3000))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, batches=7, fanout=2) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_runs_compact_and_forget_repeats(spark):
    texts = [(k, f"line number {k % 5} that is long enough\nanother line {k} that is long enough") for k in range(30)]
    hashes = line_hashes(with_row_key(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text"))
    store = LineRuns(spark, fanout=2)
    for b in range(5):
        part = hashes.where(F.col("doc_id") % 5 == b)
        assert store.unseen(part).count() == part.count()
        store.add(part, str(b))
        store.add(part, str(b))
        assert store.unseen(part).count() == 0
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert store.state().agg(F.sum("n_docs")).first()[0] == 60


def test_digest_is_of_the_kept_text(spark):
    (row,) = run(spark, [(1, "only me\nhere")])
    assert hashlib.sha256(row[3].encode()).hexdigest() == hashlib.sha256(b"only me\nhere").hexdigest()
