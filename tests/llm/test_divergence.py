import random
import re
from collections import Counter

import pytest

from orrery.llm.divergence import divergence
from orrery.llm.queries import SQL

from cases import awkward, empty


def brute(rows, least=3, top=200):
    """All terms of all pairs, as the contract words it; rows (lang, source, text)."""
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        held = Counter(t for d in here for t in d[2])
        kept = [t for t, n in held.items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}  # noqa: B023

        counts = {s: sum((d[2] for d in here if d[1] == s), Counter()) for s in {d[1] for d in here}}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_all_terms_of_all_pairs(spark):
    rng = random.Random(11)
    words = [a + b for a in "ab Éz" for b in "xyQ漢 "] + ["common"] * 9
    rows = [
        (rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "Æ", "z", None]), " ".join(rng.choices(words, k=rng.randrange(60))) if rng.random() > 0.1 else None)
        for _ in range(300)
    ]
    rows += [("en", "web", "the same row")] * 40 + [("fr", "a", "once"), ("fr", "b", ""), ("en", "silent", " 12 ")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence(df)) == brute(rows)
    assert rows_of(divergence(df, least_docs=1, top=3)) == brute(rows, 1, 3)


def test_ties_go_by_item(spark):
    rows = [("en", s, "x y") for s in "ba"] * 3 + [("en", "c", "z w")] * 3
    got = rows_of(divergence(spark.createDataFrame(rows, "lang string, source string, text string")))
    assert [r[3] for r in got if r[:3] == ("en", "c", "pair")] == ["a", "b"] and [r[3] for r in got if r[:3] == ("en", "c", "term")] == ["w", "z"]
    assert got == brute(rows)


def test_awkward_rows(spark):
    df = awkward(spark).selectExpr("*", "if(doc_id % 2 = 0, 'even', null) AS lang", "cast(doc_id % 3 AS string) AS source", "1 AS term", "2 AS total", "3 AS value")
    rows = [(r["lang"], r["source"], r["text"]) for r in df.collect()]
    assert rows_of(divergence(df, least_docs=1)) == brute(rows, 1)
    assert divergence(empty(spark).selectExpr("*", "'' AS lang", "'' AS source")).count() == 0


def test_counts_beyond_longs_times_the_scale(spark):
    from orrery.llm.divergence import share

    big = 4 * 10**18
    df = spark.createDataFrame([(big, 5 * 10**18, 7)], "n long, total long, kinds long")
    assert df.select(share(df.n, "total")).first()[0] == 1 + 10**9 * (big + 1) // (5 * 10**18 + 7)


def test_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    r = con.execute(SQL["op11_divergence"])
    at = [[c[0] for c in r.description].index(k) for k in ("lang", "source", "part", "item", "value", "rank")]
    assert rows_of(divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == sorted(tuple(x[i] for i in at) for x in r.fetchall())
