import random
import re
import time

from cases import AWKWARD, awkward, empty

from orrery.llm.licences import NOTICES, bigrams, licence_scan
from orrery.llm.licences import TEXTS as TEXTS_OF_LICENCES


def slow(text, threshold=0.8):
    lines = [x for x in (text or "").split("\n") if x.strip(" ")]
    units = lines + [text] * (len(lines) > 1)
    matched, found = 0, []
    for unit in units:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in unit)
        w = re.sub(r"[\W_]+", " ", lower).split(" ")
        w = [x for x in w if x]
        own = {f"{a} {b}" for a, b in zip(w, w[1:])}
        hits = [(2 * len(own & set(b)) / (len(own) + len(b)), name) for name, t in NOTICES if (b := bigrams(t)) and own]
        hits = [h for h in hits if h[0] >= threshold]
        matched += bool(hits)
        found += [max(hits)] if hits else []
    runs = [(d, n) for n, d in brute_runs(text or "", NOTICES + TEXTS_OF_LICENCES)]
    matched += len({n for _, n in runs} - {n for _, n in found})
    found += runs
    best = max(found, default=(0.0, None))
    return len(units), matched, ",".join(sorted({n for _, n in found})), best[1], round(best[0], 6)


TEXTS = [
    "Words first.\nReleased under the MIT License.\nwords after",
    "released UNDER the mit licence",
    "© 2020 Somebody. All rights reserved.\n\nAll   rights\treserved",
    "Licensed under the Apache License Version 2.0",
    "Licensed under\nCC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 2 or 3.",
    "all rights reserved " * 2000,
]


def test_against_all_notices(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    got = licence_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: slow(t) for i, t in docs}
    assert {r.doc_id: r.best_licence for r in got}[0] == "MIT" and {r.doc_id: r.best_licence for r in got}[4] == "CC-BY-NC-4.0"


def test_awkward_tables(spark):
    got = sorted((str(r[0]), r[2]) for r in licence_scan(awkward(spark)).collect())
    assert got == sorted((str(i), 0) for i, *_ in AWKWARD)
    assert licence_scan(empty(spark)).count() == 0
    assert licence_scan(awkward(spark), notices=[]).count() == len(AWKWARD)


def test_no_python_in_the_plan(spark):
    plan = licence_scan(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute(text, template, threshold=0.8):
    """The best coefficient of all runs of words, one by one."""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    g, t = [f"{a} {b}" for a, b in zip(w, w[1:])], set(bigrams(template))
    best = 0.0
    for i in range(len(g)):
        run = set()
        for x in g[i:]:
            run.add(x)
            best = max(best, 2 * len(run & t) / (len(run) + len(t)))
    return round(best, 6) if best >= threshold else 0.0


def test_runs_of_words(spark):
    rnd = random.Random(5)
    template = "alpha beta gamma delta alpha beta epsilon zeta eta theta"
    texts = []
    for _ in range(300):
        w = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta other words here".split()) for _ in range(rnd.randrange(12))]
        for _ in range(rnd.randrange(3)):
            copy = template.split()
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(("other", "alpha"))
            w += [*copy, *(rnd.choice(("other", "x", "y", "beta")) for _ in range(rnd.randrange(8)))]
        texts.append("".join(x + rnd.choice((" ", " ", "\n")) for x in w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan(docs, notices=[], texts=[("T", template)]).collect()}
    lines = {r.doc_id for r in got.values() if any(brute(x, template) for x in texts[r.doc_id].split("\n"))}
    assert {i for i, r in got.items() if r.licences} == {i for i, t in enumerate(texts) if brute(t, template)} > lines
    assert all(r.best_dice == brute(texts[i], template) and r.n_matched == bool(r.licences) for i, r in got.items())


def test_licence_texts_within_documents(spark):
    rnd = random.Random(6)
    prose = lambda: " ".join(f"w{rnd.randrange(900)}" for _ in range(700))
    docs = []
    for name, text in [(n, t) for n, t in TEXTS_OF_LICENCES if n in ("MIT", "BSD-3-Clause") or n == "GPL-3.0" and len(t) < 2000]:
        docs += [(name, f"{prose()}\n{text}\n{prose()}"), (name, f"{prose()} {' '.join(text.split())} {prose()}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan(df).collect()}
    assert got and all(name in got[i].licences.split(",") and got[i].best_dice == 1.0 for i, (name, _) in enumerate(docs))


def test_notice_within_a_longer_line(spark):
    df = spark.createDataFrame([(1, "Copyright 2020 Somebody and others of that name. All rights reserved. Read on.")], "doc_id long, text string")
    assert licence_scan(df).first().licences == "Proprietary"


def test_edited_notice_whatever_stands_before_it(spark):
    header = next(t for n, t in TEXTS_OF_LICENCES if n == "GPL-2.0" and len(t) < 2000)
    notice = next(t for n, t in NOTICES if n == "GPL-2.0").replace("work", "program")
    docs = [(100 * k + n, " ".join([*(f"x{i}" for i in range(n)), edited])) for k, edited in enumerate((notice, " ".join(header.split()).replace("either", "any", 1))) for n in range(21)]
    got = licence_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all("GPL-2.0" in r.licences.split(",") and r.best_dice >= 0.8 for r in got)
    assert all(len({(r.licences, r.best_dice) for r in got if r.doc_id // 100 == k and r.doc_id % 100}) == 1 for k in (0, 1))


def test_one_name_for_one_run_and_soon(spark):
    rnd = random.Random(7)
    whole = {n: t for n, t in TEXTS_OF_LICENCES if len(t) > 2000}
    docs = [(n, share, " ".join(w if rnd.random() >= share else f"edit{rnd.randrange(10**6)}" for w in t.split())) for n, t in whole.items() for share in (0, 0.01, 0.03)]
    df = spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(docs)], "doc_id long, text string").repartition(8)
    licence_scan(df.limit(1)).collect()
    began = time.time()
    got = {r.doc_id: r for r in licence_scan(df).collect()}
    assert time.time() - began < 60
    for i, (name, share, _) in enumerate(docs):
        assert name in got[i].licences.split(",") and got[i].best_dice >= 0.8 and (share or got[i].best_dice == 1.0), (name, share, got[i])
    assert got[next(i for i, (n, s, _) in enumerate(docs) if n == "GPL-3.0" and not s)].licences == "GPL-3.0"


def brute_names(text, templates):
    found = brute_runs(text, templates)
    return ",".join(sorted({n for n, _ in found})), round(max((d for _, d in found), default=0.0), 6)


def brute_runs(text, templates, threshold=0.8):
    """(name, coefficient) of every run of every template, the best first, without those that mostly lie within a better one."""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    g, found = [f"{a} {b}" for a, b in zip(w, w[1:])], []
    for name, template in templates:
        t = set(bigrams(template))
        for i in (i for i, x in enumerate(g) if x in t):
            run, mine = set(), []
            for j in range(i, min(len(g), i + 6 * len(t) + 99)):
                run.add(g[j])
                if g[j] in t and 2 * len(run & t) / (len(run) + len(t)) >= threshold:
                    mine.append((-2 * len(run & t) / (len(run) + len(t)), j - i, name, i, j))
            found += [min(mine)] if mine else []
    kept = []
    for d, n, name, i, j in sorted(found, key=lambda r: (r[0], -r[1], *r[2:])):
        if not any(2 * (min(j, y) - max(i, x) + 1) > n + 1 for _, _, _, x, y in kept):
            kept.append((d, n, name, i, j))
    return [(k[2], -k[0]) for k in kept]


def test_planted_in_the_whole_table(spark, sf_dir):
    rnd = random.Random(8)
    short = [(n, t) for n, t in TEXTS_OF_LICENCES if len(t) < 2500] + NOTICES
    docs = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        w = (r.text or "").replace("\n", " ").split()
        for _ in range(rnd.randrange(3)):
            t = rnd.choice(short)[1].split()
            for _ in range(rnd.randrange(1 + len(t) // 12)):
                t[rnd.randrange(len(t))] = rnd.choice(("of", "the", "edited"))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((r.doc_id, " ".join(w)))
    # neither lines nor units here: each text is one line, longer than the notices
    docs = [(i, t) for i, t in docs if len(t.split()) > 150]
    got = {r.doc_id: (r.licences, r.best_dice) for r in licence_scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    want = {i: brute_names(t, TEXTS_OF_LICENCES + NOTICES) for i, t in docs}
    assert got == want and sum(bool(n) for n, _ in want.values()) > 40
