"""Operator 3, toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are word lists (some given, some drawn from labelled rows), word beginnings and patterns. How often voters fire,
alone and together, over all documents gives their accuracies by the method of moments: for independent voters i, j, k,
cov_ij = p(1-p) d_i d_j, so |d_i| = sqrt(cov_ij cov_ik / cov_jk / (p(1-p))) with d the difference between the rates of
firing on toxic and on clean documents. What a covariance has beyond its model is correlation; voters that share much of
it count less. A logistic regression over hashed features is fitted on the labelled sample, then learns the posterior labels of
all documents outside the held-out fold in one distributed step, and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold, plain
from orrery.llm.factorisation import Machine, Rows, fit, pack, pack_bytes, predict
from orrery.llm.labelled import FOLDS, labelled_sample

# Common insults, by kind.
LISTS = {
    "wits": "idiot idiots moron morons stupid dumb imbecile fool halfwit dimwit",
    "worth": "loser losers worthless pathetic useless failure nobody",
    "scorn": "scum trash garbage filth vermin disgusting vile",
    "mock": "clown clowns joke laughable freak creep",
    "de": "idioten dummkopf trottel abschaum versager widerlich",
    "fr": "imbécile crétin ordure minable dégoûtant",
    "es": "idiota imbécil estúpido basura asqueroso inútil",
}
#: Words and beginnings drawn from the sample (at most), the voters that they are dealt to, the length of a beginning,
#: the log-likelihood ratio that a term needs, and the buckets of hashed words.
TERMS, VOTERS, START, RATIO, BUCKETS = 1024, 6, 5, 20.0, 1 << 13
#: How often a label is wrong, as the label model takes it.
SLIP = 0.02
WORD = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"\b(?:you|your|du|ihr|tu|vous|usted|eres)\b[^.!?]{0,40}$", re.I)


def terms(text: str | None) -> dict[str, int]:
    """How often each word occurs, in lower case."""
    found: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        found[w] = found.get(w, 0) + 1
    return found


class Voters(NamedTuple):
    """Voter of each word and of each beginning; n voters in all (three patterns and two totals last)."""

    words: dict[str, int]
    starts: dict[str, int]
    n: int

    def hits(self, text: str | None, found: dict[str, int]) -> np.ndarray:
        """How often each voter's evidence occurs; a voter fires where this is not 0."""
        out = np.zeros(self.n)
        bad = {}
        for w, count in found.items():
            a, b = self.words.get(w), self.starts.get(w[:START])
            if a is not None:
                out[a] += count
            if b is not None:
                out[b] += count
            if a is not None or b is not None:
                bad[w] = count
        base = self.n - 5
        if bad:
            for m in re.finditer("|".join(rf"\b{re.escape(w)}\b" for w in bad), text, re.I):
                before = text[max(0, m.start() - 60) : m.start()]
                out[base] += bool(ADDRESS.search(before))
                out[base + 1] += m.group().isupper()
                out[base + 2] += text[m.end() : m.end() + 1] == "!"
        out[base + 3], out[base + 4] = len(bad) > 1, sum(bad.values()) > 2
        return out


class Model(NamedTuple):
    voters: Voters
    classifier: Machine


def features(voters: Voters, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, feature numbers, values): voters' evidence, its density and hashed words of unit length together."""
    found = terms(text)
    hits = voters.hits(text, found)
    fired = np.flatnonzero(hits)
    bucket = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found), np.int64, len(found)))
    index = np.concatenate([[0], 1 + fired, 1 + voters.n + fired, 1 + 2 * voters.n + bucket])
    value = np.concatenate([[1.0], np.ones(len(fired)), np.log1p(hits[fired]), np.full(len(bucket), 1 / max(1, len(bucket)) ** 0.5)])
    return hits > 0, index, value


def choose_voters(sample: DataFrame) -> Voters:
    """Given lists, and the terms most tied to the label in the sample (counted by Spark), dealt to voters in turn."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found = terms(text)
                for t in {*(f"w{w}" for w in found), *(f"s{w[:START]}" for w in found if len(w) > START)}:
                    count.setdefault(t, [0, 0])[label] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in count.items()], columns=["term", "clean", "toxic"])

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    seen = sample.mapInPandas(emit, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), rate, F.lit(share)) + part(F.col("clean"), 1 - rate, F.lit(1 - share)))
    seen = seen.withColumn("rate", rate).withColumn("ratio", ratio).filter((F.col("ratio") >= RATIO) & (F.col("rate") >= 0.8) & (F.length("term") <= 64))
    drawn = [r.term for r in seen.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()]
    given = {w: k for k, line in enumerate(LISTS.values()) for w in line.split()}
    base = len(LISTS)
    words = {t[1:]: base + i % VOTERS for i, t in enumerate(x for x in drawn if x[0] == "w")} | given
    starts = {t[1:]: base + VOTERS + i % VOTERS for i, t in enumerate(x for x in drawn if x[0] == "s")}
    return Voters(words, starts, base + 2 * VOTERS + 5)


def moments(docs: DataFrame, voters: Voters) -> np.ndarray:
    """How often each two voters fire together (a voter with itself: alone) over all documents; last: the number of documents."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(voters.n**2 + 1)
        for batch in batches:
            for text in batch["text"]:
                votes = np.flatnonzero(voters.hits(text, terms(text)))
                total[(votes[:, None] * voters.n + votes[None, :]).ravel()] += 1
                total[-1] += 1
        yield pd.DataFrame({"cell": np.flatnonzero(total), "n": total[total > 0].astype(np.int64)})

    out = np.zeros(voters.n**2 + 1)
    for r in docs.select("text").mapInPandas(emit, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # voters.n**2 + 1 rows at most
        out[r.cell] = r.n
    return out


def label_model(moment: np.ndarray, n: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of firing on toxic and on clean documents, and each voter's weight after its correlations."""
    joint = moment[:-1].reshape(n, n) / max(1.0, moment[-1])
    rate, spread = np.diag(joint).copy(), share * (1 - share)
    cov = joint - np.outer(rate, rate)
    live = np.flatnonzero(rate > 0)
    d = np.zeros(n)
    for i in live:
        found = [abs(cov[i, j] * cov[i, k] / cov[j, k]) for j in live for k in live if j < k and i not in (j, k) and cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0]
        d[i] = np.sqrt(np.median(found) / spread) if found else rate[i] / share * 0.5
    d = np.minimum(d, np.minimum(rate / share, (1 - rate) / (1 - share)) * 0.999)
    toxic, clean = rate + (1 - share) * d, rate - share * d
    rest = cov - spread * np.outer(d, d)
    size = np.sqrt(np.outer(share * toxic * (1 - toxic) + (1 - share) * clean * (1 - clean), share * toxic * (1 - toxic) + (1 - share) * clean * (1 - clean))) + 1e-9
    tied = np.clip(rest / size, 0, 1)
    np.fill_diagonal(tied, 0)
    clip = lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    return clip(toxic), clip(clean), np.where(rate > 0, 1 / (1 + tied.sum(1)), 0.0)


def evidence(votes: np.ndarray, share: float, toxic: np.ndarray, clean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log odds that each row of votes is of a toxic document."""
    return np.log(share / (1 - share)) + votes @ (weight * np.log(toxic / clean)) + (1 - votes) @ (weight * np.log((1 - toxic) / (1 - clean)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text). The label model's moments come from all documents; its posteriors are what the classifier learns.

    It is fitted on the labelled sample (SAMPLE rows), where a label is one more, nearly sure, voter, and then moved by the
    posteriors of all documents that are not held out. Labels also give the share of toxic documents and choose terms.
    """
    sample = labelled_sample(docs, labels, "toxic")
    voters = choose_voters(sample)

    @F.pandas_udf("votes binary, index binary, value binary")
    def extract(texts: pd.Series) -> pd.DataFrame:
        rows = (features(voters, t) for t in texts)
        return pd.DataFrame([(v.tobytes(), i.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for v, i, x in rows], columns=["votes", "index", "value"])

    rows = sample.select("label", extract("text").alias("f")).select("label", "f.*").toPandas()  # bounded: labelled.SAMPLE
    gold = rows["label"].to_numpy(float) if len(rows) else np.empty(0)
    known = ~np.isnan(gold)
    share = float(np.clip((np.nansum(gold) + 0.5) / (known.sum() + 1), 0.01, 0.99))
    rates = label_model(moments(docs, voters), voters.n, share)
    odds = evidence(np.frombuffer(b"".join(rows["votes"]), np.bool_).reshape(-1, voters.n).astype(float), share, *rates)
    odds += np.where(known, np.where(gold > 0, 1, -1) * np.log((1 - SLIP) / SLIP), 0.0)
    posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = pack_bytes(rows["index"], rows["value"])
    first = fit(x, posterior, 1 + 2 * voters.n + BUCKETS, rank=0)
    return Model(voters, learn_all(docs.filter(fold(F.col("doc_id"), FOLDS) != 0), voters, first, x, share, rates))


def slopes(m: Machine, x: Rows, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows, for each feature, of the logistic loss's slope and of a bound of its curvature for all features moved at once."""
    size = np.diff(np.append(x.begin, len(x.index)))
    off = np.repeat(predict(m, x) - target, size)
    reach = np.repeat(np.add.reduceat(np.abs(x.value), x.begin) if len(x.begin) else np.empty(0), size)
    n = len(m.linear)
    return np.bincount(x.index, off * x.value, n), np.bincount(x.index, np.abs(x.value) * reach / 4, n)


def learn_all(docs: DataFrame, voters: Voters, first: Machine, sample: Rows, share: float, rates: tuple[np.ndarray, ...]) -> Machine:
    """``first`` moved against the loss on the posteriors of all texts of docs, which counts as much as that on the sample.

    The bound of curvature makes the step one that cannot raise the loss. Tasks add up two numbers a feature; their sums,
    a row for each feature, reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast((voters, first, share, rates))  # as score_column

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, m, share, rates = shared.value
        n, g, h = 0, np.zeros(len(m.linear)), np.zeros(len(m.linear))
        for batch in batches:
            for a in range(0, len(batch), 512):
                rows = [features(v, t) for t in batch["text"].iloc[a : a + 512]]
                target = 1 / (1 + np.exp(-np.clip(evidence(np.array([r[0] for r in rows], float), share, *rates), -30, 30)))
                more = slopes(m, pack([r[1:] for r in rows]), target)
                n, g, h = n + len(rows), g + more[0], h + more[1]
        used = np.flatnonzero(h)
        yield pd.DataFrame({"feature": np.append(used, -1).astype(np.int32), "g": np.append(g[used], n), "h": np.append(h[used], 0.0)})

    found = docs.select("text").mapInPandas(emit, "feature int, g double, h double").groupBy("feature").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    n = max(1.0, next((r.g for r in found if r.feature < 0), 0.0))
    bend = slopes(first, sample, np.zeros(len(sample.begin)))[1] / max(1, len(sample.begin))
    linear = first.linear.copy()
    for r in found:  # a row for each feature at most
        if r.feature >= 0:
            linear[r.feature] -= (r.g / n) / (r.h / n + bend[r.feature])
    return first._replace(linear=linear)


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms and BUCKETS weights

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = [predict(m.classifier, pack([features(m.voters, t)[1:] for t in texts[a : a + 512]])) for a in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts count as empty ones. Without labelled rows the given word lists alone decide. Repeated rows and null ids
    give one row each; further columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    model = train(docs, labels)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score_column(docs, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
