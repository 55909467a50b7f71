import numpy as np
from cases import AWKWARD, awkward, empty

from orrery.llm import factorisation as fm
from orrery.llm.quality import quality, statistics
from orrery.llm.toxicity import label_model, toxicity


def test_sum_of_squares_identity():
    rnd = np.random.default_rng(1)
    m = fm.Machine(0.3, rnd.normal(size=20), rnd.normal(size=(20, 4)))
    rows = [(np.sort(rnd.choice(20, 5, replace=False)), rnd.normal(size=5)) for _ in range(10)]
    got, _ = fm.sums(m, fm.pack(rows))
    for (i, x), y in zip(rows, got, strict=True):
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(5) for b in range(a + 1, 5))
        assert abs(m.bias + m.linear[i] @ x + pairs - y) < 1e-9


def test_machine_learns_an_interaction():
    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 2, (3000, 2))
    rows = [(np.array([0, 1 + a, 3 + b]), np.ones(3)) for a, b in bits]
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    x = fm.pack(rows)
    assert ((fm.predict(fm.fit(x, y, 5, 4, rounds=40), x) > 0.5) == y).mean() > 0.95
    assert ((fm.predict(fm.fit(x, y, 5, 0, rounds=40), x) > 0.5) == y).mean() < 0.8


def test_label_model_finds_rates():
    rnd = np.random.default_rng(3)
    y = rnd.random(200000) < 0.2
    toxic, clean = np.array([0.7, 0.5, 0.6, 0.4]), np.array([0.05, 0.1, 0.02, 0.2])
    votes = (rnd.random((len(y), 4)) < np.where(y[:, None], toxic, clean)).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # one voter copied: the two must count less
    a, b, w = label_model(np.append((votes.T @ votes).ravel(), len(y)), 5, 0.2)
    assert np.abs(a[1:4] - toxic[1:]).max() < 0.12 and np.abs(b[1:4] - clean[1:]).max() < 0.05
    assert w[0] < 0.8 and w[4] < 0.8 and w[1] > w[0]


def measure(spark, sf, score, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels.select("doc_id", label), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r[label] for r in held) / len(held)
    return right, rows


def test_held_out_accuracy(spark):
    right, rows = measure(spark, "sf0.1", toxicity, "toxic")
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)
    right, rows = measure(spark, "sf0.1", quality, "quality")
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, 0, 0), (None, 1, 1), (7, None, None), (8, 9, 9), (9, 1, 0)], "doc_id long, toxic int, quality int")
    for score in (toxicity, quality):
        for gold in (labels, labels.limit(0)):
            rows = score(awkward(spark), gold).collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in AWKWARD)
            assert all(0 <= r.score <= 1 for r in rows)
        assert score(empty(spark), labels).count() == 0
    assert len(statistics("")[0]) == len(statistics("some words\nin lines")[0])


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    from orrery.llm import labelled

    monkeypatch.setattr(labelled, "SAMPLE", 10)
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(500)] + [(1, f"again {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert labelled.labelled_sample(docs, labels, "toxic").count() == 10


def test_label_model_alone_against_gold(spark):
    """Posteriors without any label's vote, on documents that no label was learned from."""
    from orrery.llm import labelled, toxicity as weak

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    voters = weak.choose_voters(labelled.labelled_sample(docs, labels, "toxic"))
    held = docs.join(labels, "doc_id").filter(labelled.fold(docs["doc_id"], 5) == 0).collect()
    votes = np.array([voters.hits(r.text, weak.terms(r.text)) > 0 for r in held], float)
    gold = np.array([r.toxic for r in held])
    odds = weak.evidence(votes, 0.1, *weak.label_model(weak.moments(docs, voters), voters.n, 0.1))
    assert ((odds > 0) == gold).mean() > 0.9
