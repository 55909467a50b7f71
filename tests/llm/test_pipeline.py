"""Each stage against plain Python on its own input, and the whole against its stages."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.simhash import fingerprint
from orrery.llm.suffixes import item_words
from orrery.llm.toxicity import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_columns_stay(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == columns


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in toxicity(before, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == keep


def test_near_duplicates(steps):
    before, after = (df.select("doc_id", "text").collect() for df in steps["near_duplicates"])
    before = sorted(before)
    f = np.array([fingerprint(r.text) for r in before], np.uint64)
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after} == {before[find(i)].doc_id for i in range(len(before))}


def test_passages(steps):
    before, after = ({r.doc_id: r.text.split() for r in df.collect()} for df in steps["passages"])
    assert set(after) <= set(before)
    for i, w in after.items():
        rest = iter(before[i])
        assert all(x in rest for x in w)  # words are cut, never changed
    runs: dict[tuple, set] = {}
    for i, w in after.items():
        for k in range(len(w) - 54):
            runs.setdefault(tuple(x.lower() for x in w[k : k + 55]), set()).add(i)
    assert not [ids for ids in runs.values() if len(ids) > 1]


def test_decontamination(spark, steps):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in steps["decontamination"])
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(r.text)
        wins |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    dirty = {i for i, t in before.items() for w in [item_words(t)] if any(tuple(w[k : k + 10]) in wins for k in range(len(w) - 9))}
    assert set(after) == set(before) - dirty and dirty


def test_tokens(steps):
    before, after = steps["tokens"]
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == want


def test_stages_bear_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 1), (3, "same text here", "en", "s", 1), (None, "another one", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for kind, df in (("rows", docs), ("empty", docs.limit(0))):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        ids = [r.doc_id for r in df.collect()]
        assert ids == [] if "empty" in kind else sorted(map(str, ids)) == ["1", "3", "None"]  # 2 is as empty as 1; rows of 3 are alike
    assert docs.columns == corpus_pipeline.near_duplicates_stage(spark, docs, SF).columns
    assert corpus_pipeline.near_duplicates_stage(spark, docs, SF).filter(F.col("doc_id") == 3).count() == 1


def test_unlike_documents_without_or_with_one_id_stay(spark):
    texts = [" ".join(f"{c}{i * k}" for i in range(1, 40)) for k, c in enumerate("abcdefgh", 1)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])] + [(5, texts[4]), (5, texts[5]), (6, texts[6]), (None, texts[6])]
    got = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in spark.createDataFrame([*rows[:4], *rows[5:8]], "doc_id long, text string").collect())


def test_columns_of_any_name_and_unlike_rows_of_one_id(spark):
    texts = [" ".join(f"{c}{i * k}" for i in range(1, 60)) for k, c in enumerate("abcde", 1)]
    names = ["__i", "__m", "__s", "__id", "__mark", "row", "mark", "component", "found", "spans", "n", "n_hit", "whole", "new", "d.text", "first"]
    rows = [(i, t, *[f"{t[0]}{n}" for n in names]) for i, t in zip([None, None, None, 4, 4], texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert sorted(map(repr, after.collect())) == sorted(map(repr, docs.collect()))
