import random

import numpy as np
from cases import AWKWARD, awkward, empty

from orrery.llm import passages
from orrery.llm.common import words


def test_compact_windows_cover_every_subsequence_once():
    values = np.random.default_rng(0).integers(0, 60, 300).astype(np.uint64) << np.uint64(40)  # many ties
    block, l, c, r = passages.compact_windows(values, np.array([0, 150]), np.array([149, 299]), np.array([0, 1]))
    for first, last in ((0, 149), (150, 299)):
        for i in range(first, last + 1):
            for j in range(i + passages.SPAN - 1, last + 1):
                k = np.flatnonzero((l <= i) & (i <= c) & (c <= j) & (j <= r))
                assert len(k) == 1 and values[c[k[0]]] == values[i : j + 1].min()


def test_word_hashes(monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcÉé\t") for _ in range(rnd.randint(1, 6))) for _ in range(400)), "", None, "x", " \n ", "y" * 500]
    whole = [passages.word_hashes(t) for t in texts]
    seen = {}
    for t, h in zip(texts, whole, strict=True):
        assert len(h) == len(words(t))
        assert all(seen.setdefault(w, x) == x for w, x in zip(words(t), h.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(passages, "PIECE", 90)
    assert all((a == passages.word_hashes(t)).all() for a, t in zip(whole, texts, strict=True))


def make(seed=3):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared, other = fresh(60), fresh(3000)
    docs = {i: fresh(rnd.choice((40, 90, 400))) for i in range(40)}
    holds = {}
    for i in (41, 43, 44, 46):
        docs[i], holds[i] = [*fresh(70), *shared, *fresh(50)], range(70, 130)
    docs[45] = [*fresh(30), *shared[:48], *fresh(30)]  # too short to count
    edited = list(shared)
    edited[30] = "edited"
    docs[47], holds[47] = [*fresh(20), *edited, *fresh(20)], range(20, 80)
    docs[50], docs[51] = other, [*other]  # copies, of several blocks
    holds[51] = range(3000)
    return docs, holds


def test_planted_passages(spark):
    docs, holds = make()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in passages.passage_report(df).collect()}
    assert {i for i, r in rows.items() if r.repeated} == {*holds, 50}
    assert all(rows[i].class_id == 41 for i in (41, 43, 44, 46, 47)) and rows[51].class_id == 50 and rows[41].n_repeated == 0
    for i in (43, 44, 46, 47, 51):
        assert abs(rows[i].n_repeated - len(holds[i])) <= 1, (i, rows[i])
    assert all(r.class_id == i for i, r in rows.items() if not r.repeated)


def test_cutting(spark):
    docs, holds = make(4)
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in docs.items()], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in passages.cut_repeats(df).collect()}
    assert set(got) == set(docs) - {51} and got[50].text == " ".join(docs[50]) and got[50].spans == "x"
    for i in set(docs) - set(holds) | {41}:
        assert got[i].text == " ".join(docs[i])
    assert got[43].text.split() == docs[43][:70] + docs[43][130:]


def test_awkward_tables(spark):
    report = passages.passage_report(awkward(spark)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in report) == sorted((str(i), len(words(t))) for i, t, *_ in AWKWARD)
    assert passages.cut_repeats(awkward(spark)).count() == len(AWKWARD)
    assert passages.passage_report(empty(spark)).count() == 0 and passages.cut_repeats(empty(spark)).count() == 0


def test_recall_at_the_stated_similarity(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(300):  # one changed word in the middle of 50: similarity 41/51
        w = [f"w{rnd.randrange(10**7)}" for _ in range(50)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:25], "changed", *w[26:]]))]
    report = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.repeated for r in report if r.doc_id % 2) >= 299


def test_later_documents_meet_when_the_first_is_unlike(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(600):  # an unlike first holder: 40 of 46 shingles; the two after it are copies
        w = [f"w{rnd.randrange(10**7)}" for _ in range(50)]
        rows += [(3 * k, " ".join([*w[:25], "two", "changed", *w[27:]])), (3 * k + 1, " ".join(w)), (3 * k + 2, " ".join(w))]
    report = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.repeated == (r.doc_id % 3 > 0) and r.class_id == r.doc_id // 3 * 3 + (r.doc_id % 3 > 0) for r in report)


def by_hand(rows):
    """Who shares a passage with whom, by comparing every two texts that have a shingle in common, whole."""
    h = [passages.word_hashes(t).astype(np.uint32).astype(np.uint64) for _, t in rows]
    holders, met = {}, set()
    for k, x in enumerate(h):
        for g in set(passages.shingles(x).tolist()):
            met |= {(o, k) for o in holders.setdefault(g, [])}
            holders[g].append(k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = set()
    for i, j in met:
        here, there, _ = passages.similar_spans(h[j], h[i])
        if len(here) and len(there):
            alike |= {i, j}
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {rows[i][0]: (i in alike, rows[find(i)][0]) for i in range(len(rows))}


def check_by_hand(spark, rows):
    rows = sorted(rows)
    report = passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = by_hand(rows)
    wrong = [r.doc_id for r in report if (r.repeated, r.class_id) != want[r.doc_id]]
    assert not wrong, (len(wrong), wrong[:5])
    return {r.doc_id: r for r in report}


def test_table_by_hand(spark, sf_dir):
    check_by_hand(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_edits_and_common_lines_by_hand(spark):
    rnd = random.Random(13)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    lines = [fresh(n) for n in (14, 20, 30, 40, 45)]
    rows = []
    for k in range(60):  # 12 passages around common lines, each in five texts with an edit or none
        if k % 5 == 0:
            core = [*fresh(12), *lines[k // 5 % 5], *fresh(30)]
        w = [*fresh(30), *core, *fresh(30)]
        for _ in range(k % 3):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = fresh(rnd.randint(0, 1))
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*fresh(40), *lines[k % 5], *fresh(40)])) for k in range(60)]  # the lines alone
    check_by_hand(spark, rows)


def report_of(spark, texts):
    return {r.doc_id: r for r in passages.passage_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_unlike_first_documents_hide_nothing(spark):
    rnd = random.Random(14)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    texts = {}
    for k in range(4):
        for case in range(3):
            p = fresh(50)
            q = [*p[: 10 + 8 * k], "changed", *p[11 + 8 * k :]] if k else p  # the same words, or one of them changed
            around = lambda w: " ".join([*fresh(20), *w, *fresh(20)])
            base, here = 100 * k + 10 * case, {3: around(p), 4: around(q)}
            if case:
                here |= {1: around(p[:32]), 2: around(p[19:])}
            if case == 2:
                here |= {5: around(q[:32]), 6: around(q[19:])}
            texts |= {base + i: t for i, t in here.items()}
    rows = report_of(spark, texts)
    for i, r in rows.items():
        assert (r.repeated, r.n_repeated) == (i % 10 in (3, 4), 50 * (i % 10 == 4)), r
        assert r.class_id == (i - 1 if i % 10 == 4 else i)


def test_passages_put_together_from_others_by_hand(spark):
    rnd = random.Random(15)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    whole = [fresh(120) for _ in range(5)]
    rows = []
    for k in range(60):
        w = fresh(15)
        for _ in range(rnd.randint(1, 4)):  # pieces of a few sources, some of passage length, some edited, next to each other
            source, size = rnd.choice(whole), rnd.randint(15, 70)
            at = rnd.randrange(120 - size)
            piece = source[at : at + size]
            if rnd.random() < 0.4:
                piece[rnd.randrange(size)] = "edited"
            w += piece + (fresh(5) if rnd.random() < 0.5 else [])
        rows.append((k, " ".join(w)))
    report = check_by_hand(spark, rows)
    words_of = [t.split() for _, t in rows]
    seen, covered = set(), {}
    for k, w in enumerate(words_of):  # words of 50 and more that an earlier document has verbatim
        grams = [" ".join(w[i : i + 50]) for i in range(len(w) - 49)]
        covered[k] = len({j for i, g in enumerate(grams) if g in seen for j in range(i, i + 50)})
        seen |= set(grams)
    assert all(report[k].n_repeated >= n for k, n in covered.items()) and sum(covered.values()) > 300


def lines_with_edits(seed, n):
    """Texts around common lines of 45 to 47 words with their neighbours, some alike but for a word, most unlike."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    lines = [fresh(45), fresh(47), fresh(33)]
    cores = [[*fresh(3), *lines[k % 3], *fresh(20)] for k in range(n // 4)]
    rows = []
    for k in range(n):
        w = list(rnd.choice(cores)) if k % 2 else [*fresh(5), *lines[k % 3], *fresh(5)]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = fresh(rnd.randint(0, 1))
        rows.append((k, " ".join([*fresh(rnd.randint(0, 70)), *w, *fresh(rnd.randint(0, 70))])))
    return rows


def test_pairs_of_surroundings_by_hand():
    rows = lines_with_edits(16, 120)
    words_of = [passages.word_hashes(t).astype(np.uint32).astype(np.uint64)[:141] for _, t in rows]
    alike = lambda k, o: all(map(len, passages.similar_spans(words_of[k], words_of[o])[:2]))
    want = {(k, o) for k in range(120) for o in range(k) if alike(k, o)}
    got = [(k, o) for k, o, _ in passages.alike_pairs(words_of, list(range(120)), [0] * 120)]
    assert set(got) <= want and len(want) > 30
    assert {k: min(o for x, o in want if x == k) for k, _ in want} == {k: min(o for x, o in got if x == k) for k, _ in got}
    assert {(k, o) for k, o, _ in passages.alike_pairs(words_of, [0] * 60 + [1] * 60, [0] * 120)} <= {(k, o) for k, o in want if o < 60 <= k}
    across = {(k, o) for k, o in want if k % 2 != o % 2}
    found = [(k, o) for k, o, _ in passages.alike_pairs(words_of, list(range(120)), [k % 2 for k in range(120)])]
    assert set(found) <= across and {k for k, _ in found} == {k for k, _ in across}


def test_few_tables_for_edits_of_common_lines(spark, monkeypatch):
    written = []
    monkeypatch.setattr(passages, "keep", lambda df, keep=passages.keep: written.append(1) or keep(df))
    check_by_hand(spark, lines_with_edits(17, 90))
    assert len(written) < 30  # more than two rounds before


def test_blocks_and_rounds_find_the_same(spark, monkeypatch):
    rows = lines_with_edits(18, 90)
    monkeypatch.setattr(passages, "TOGETHER", 8)
    check_by_hand(spark, rows)
    monkeypatch.setattr(passages, "DEALT", 8)  # hotter keys go on in rounds
    check_by_hand(spark, rows)


def test_a_large_class_of_copies_needs_no_rounds(spark, monkeypatch):
    rnd = random.Random(19)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    line, same = fresh(30), fresh(60)
    texts = {k: [*same, *fresh(70), *line, *fresh(70)] for k in range(40)}  # one class, a key with 45 surroundings
    texts |= {k: [*fresh(70), *line, *fresh(70)] for k in range(50, 54)}
    edited = texts[5][130:190]
    texts[60] = [*fresh(30), *edited[:40], "changed", *edited[41:], *fresh(30)]
    times = []
    monkeypatch.setattr(passages, "shared_windows", lambda *a, f=passages.shared_windows: times.append(1) or f(*a))
    monkeypatch.setattr(passages, "TOGETHER", 16)
    monkeypatch.setattr(passages, "DEALT", 16)
    got = check_by_hand(spark, [(k, " ".join(w)) for k, w in texts.items()])
    assert got[60].class_id == 0 and len(times) == 1  # rounds before: more surroundings than DEALT
