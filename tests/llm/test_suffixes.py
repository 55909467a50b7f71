import hashlib
import random
import re

from cases import AWKWARD, awkward, empty

from orrery.llm import suffixes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def slow(docs, items):
    out = []
    for i, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for k, t in items:
            x = split(t)
            size = min(10, len(x))
            wins = {tuple(x[a : a + size]) for a in range(len(x) - size + 1)} if x else set()
            for p in range(len(w) - size + 1 if x else 0):
                if tuple(w[p : p + size]) in wins:
                    hit.update(range(p, p + size))
                    found.add(k)
        names = sorted(str(k) for k in found if k is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, schema="doc_id long, text string"):
    df = spark.createDataFrame(docs, schema) if isinstance(docs, list) else docs
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffixes.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, got), key=str)


def test_against_all_windows(spark, monkeypatch):
    rnd = random.Random(8)
    vocabulary = ["a", "B", "c1", "é", "dd"]
    text = lambda n: rnd.choice((" ", ", ", "-")).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice((0, 1, 2, 3, 9, 10, 11, 30)))) for k in range(12)] + [(3, "c1 c1 c1"), (99, None), (None, "a b a b a b a b a b a")]
    items = [x for x in items if len(split(x[1])) != 1] + [(50, "zz")]
    docs = [(i, text(rnd.choice((0, 1, 5, 12, 60, 300))) + rnd.choice(("", " zz", " ".join(["", items[4][1] or ""])))) for i in range(150)]
    assert run(spark, docs, items) == slow(docs, items)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 60)  # several passes over the test table
    assert run(spark, docs, items) == slow(docs, items)


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"), (2, " ".join(f"w{i}" for i in range(9)))]
    rows = {r.doc_id: r for r in suffixes.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (rows[1].longest, rows[1].longest_at, rows[1].items) == (20, 2, ["7"]) and (rows[2].longest, rows[2].contaminated) == (0, False)


def test_awkward_tables(spark):
    items = [(1, "quick brown fox jumps over the lazy dog"), (2, "ein"), (3, "word other word")]
    assert run(spark, awkward(spark), items) == slow(AWKWARD, items)
    assert run(spark, awkward(spark), []) == slow(AWKWARD, [])
    assert run(spark, empty(spark), items) == []
