import random
import re
import zlib
from collections import Counter

import pandas as pd

from orrery.llm.queries import op12_variants
from orrery.llm.variants import CUT, GAP, OWN, keys, roots, spelling_variants

from cases import awkward, empty


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def brute(rows, least=3, factor=2):
    """Every two words compared; rows (doc_id, text)."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= least}
    by_length = {}
    for w in count:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in count.items():
        beside = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if x != w and near(w, x)]
        best = min(beside, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= factor * n else None
        out[w] = (form[w], n, len(beside), count[best] if form[w] else None)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_made_up_words(spark):
    rng = random.Random(12)
    base = ["".join(rng.choices("abé÷", k=rng.randrange(4, 10))) for _ in range(60)]
    words = [rng.choice(base) for _ in range(9000)]
    for i in rng.sample(range(9000), 4000):
        w, at, c = words[i], rng.randrange(len(words[i])), rng.choice("abéZÀ")
        words[i] = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
    rows = [(i or None, rng.choice([" ", "-", "漢", "\n"]).join(words[100 * i : 100 * i + 100])) for i in range(90)]
    got = rows_of(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert got == want and sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])


def test_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op12_variants(spark, sf_dir))
    assert got == brute(rows) and len(got) > 2000


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for least in (1, 3):
        assert rows_of(spelling_variants(df.selectExpr("*", "1 AS word", "2 AS n", "3 AS id"), least_count=least)) == brute(rows, least)
    assert spelling_variants(empty(spark)).count() == 0


def test_ties_and_very_long_words(spark):
    long = "ab" * 20_000
    text = " ".join(["house"] * 3 + ["mouse"] * 8 + ["louse"] * 8 + [long] * 3 + [long[:-1]] * 9 + ["aaaaab"] * 4 + ["aaaab"] * 9)
    got = {r[0]: r for r in rows_of(spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"))) if r[3] >= 3}
    assert got["house"][1] == "louse" and got["house"][4] == 2
    assert got["mouse"][1] is None and got[long][1] == long[:-1] and got["aaaaab"][1] == "aaaab"


def test_roots_of_a_long_chain(spark):
    n = 300
    df = spark.createDataFrame(pd.DataFrame({"id": range(1, n), "form": range(n - 1)}))
    assert {tuple(r) for r in roots(df).collect()} == {(i, 0) for i in range(1, n)}


def test_keys_tell_places_apart():
    found = {k: set(zip(x.tolist(), y.tolist(), strict=True)) for k, _, x, y in keys(["abcde", "bacde", "aabcde", "abcdef"])}
    assert len(found[OWN]) == 4 and len(found[OWN] & found[CUT]) == 1 and len(found[GAP]) == 5 + 5 + 6 + 6
