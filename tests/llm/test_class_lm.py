import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from orrery.llm import class_lm
from orrery.llm.common import keep, words


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def slow_base(docs):
    """The unigram score by the definition."""
    count, n = Counter(), 0
    for i, t in docs:
        if not held(i):
            count.update([*words(t), None])
    n = sum(count.values())
    floor = n + 0.1 * (len(count) + 1)
    out = []
    for i, t in docs:
        w = [*words(t), None]
        out.append((str(i), held(i), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 0.1) / floor) for x in w), 6)))
    return sorted(out)


def corpus(n=300):
    rnd = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("un", "deux", "drei")]
    return [(i, " ".join(rnd.choice(kinds[i % 3]) if rnd.random() < 0.97 else f"rare{rnd.randrange(4000)}" for _ in range(rnd.randint(0, 60)))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Few words are held by the workers, so that the others are joined (this setting is the driver's alone)."""
    monkeypatch.setattr(class_lm, "HELD", 100)


def test_base_counts_and_gain(spark, small):
    docs = corpus()
    rows = class_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == slow_base(docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_add_up(spark, small):
    docs = spark.createDataFrame([t for t in corpus(120)], "doc_id long, text string")
    vocabulary = keep(class_lm.count_words(docs.select("text")))
    m = class_lm.fit(docs.select("text"), vocabulary)
    assert np.allclose((10**m.transition).sum(2), 1)
    count = {bytes(r.word): r.n for r in vocabulary.collect()}
    total = np.zeros(class_lm.CLASSES)
    total[class_lm.END] += 1
    for w, n in count.items():
        o = m.lexicon.object_of(w)
        b = o - class_lm.OBJECTS - 1
        total[m.class_of[o]] += 10 ** (m.in_class[o] + (math.log10(n - m.discount) - m.log_size[b] if b >= 0 else 0))
    for b in range(class_lm.BUCKETS):
        o = class_lm.OBJECTS + 1 + b
        total[m.class_of[o]] += 10 ** (m.in_class[o] + m.log_unknown[b])
    used = np.unique(m.class_of[[0, *m.lexicon.own.values(), *range(class_lm.OBJECTS + 1, class_lm.OBJECTS + 1 + class_lm.BUCKETS)]])
    assert np.allclose(total[used], 1)


def test_score_by_hand(spark, small):
    """The distributed score against the model's own tables, word by word."""
    docs = corpus(80)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", F.lit(False))
    vocabulary = keep(class_lm.count_words(df.select("text")))
    m = class_lm.fit(df.select("text"), vocabulary)
    count = {bytes(r.word): r.n for r in vocabulary.collect()}
    got = {r.doc_id: r.score for r in class_lm.apply(spark.createDataFrame([*docs, (999, "never seen at all")], "doc_id long, text string").withColumn("held_out", F.lit(True)), m, vocabulary).collect()}
    for i, t in [*docs, (999, "never seen at all")]:
        a = b = class_lm.END
        s = 0.0
        for w in [*words(t), None]:
            o = class_lm.END if w is None else m.lexicon.object_of(w)
            c = m.class_of[o]
            s += m.transition[a, b, c] + m.in_class[o]
            if o > class_lm.OBJECTS:
                k = o - class_lm.OBJECTS - 1
                s += math.log10(count[w] - m.discount) - m.log_size[k] if w in count else m.log_unknown[k]
            a, b = b, c
        assert abs(got[i] - s) < 1e-6


def test_awkward_tables(spark, small):
    got = class_lm.lm_scores(awkward(spark)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == slow_base([(i, t) for i, t, *_ in AWKWARD])
    assert class_lm.lm_scores(empty(spark)).count() == 0
