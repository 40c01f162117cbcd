import random
import re

from graphloom.llm.phrases import build_index, decontaminate, documents_of, items_of, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        ws, hit, ids = words(t), set(), set()
        for j, u in items:
            iw = words(u)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        if j is not None:
                            ids.add(str(j))
        out.append((i, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, pos int, term string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate(d, b).collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(30)] + ["Ünder", "THE", "été", "don", "42"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.choice([1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(None, text(12)), (20, ""), (21, None), (22, "...!?"), (5, text(14))]
    docs = [(k, text(60)) for k in range(15)]
    for k, (_, u) in enumerate(items):
        cut = (u or "").split()
        docs.append((100 + k, f"{text(5)}, {u} -- {(u or '').upper()} {text(4)} {' '.join(cut[2:13])}"))
    docs += [(None, items[4][1]), (7, None), (8, ""), (9, "x" * 50_000), docs[3], docs[3], (3, items[5][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_proximity_in_any_order(spark):
    docs = documents_of(spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "gamma z z z z z z z alpha beta"), (3, "beta alpha gamma")], "doc_id long, text string"), "doc_id", "text")
    items = items_of(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    found = {(r.doc_id, r.start, r.end) for r in proximity_matches(build_index(docs), items, 6).collect()}
    assert found == {(1, 0, 5), (3, 0, 2)}
