"""Operator 10, quality: a factorisation machine over hashed words, structure statistics and lengths."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold, plain
from orrery.llm.factorisation import Machine, fit, pack, pack_bytes, predict
from orrery.llm.labelled import FOLDS, labelled_sample

#: Buckets of hashed words, bins of each statistic, factors of an interaction.
BUCKETS, BINS, RANK = 1 << 12, 10, 8
_all = bytes(range(256))
_class = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:", "shout": b"!?", "pipe": b"|", "sign": b"#$%&*@^~=+_<>\\/{}[]", "control": bytes([*range(9), *range(14, 32), 127]), "high": bytes(range(128, 256)),
}
_others = {k: bytes(b for b in _all if b not in v) for k, v in _class.items()}


def statistics(text: str | None) -> tuple[list[float], dict[bytes, int]]:
    """About two dozen figures of a text's structure, and how often each of its words occurs."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = {k: len(raw.translate(None, other)) for k, other in _others.items()}
    w = raw.split()
    found: dict[bytes, int] = {}
    for x in w:
        found[x] = found.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    total, kinds = max(1, len(w)), max(1, len(found))
    letters = max(1, count["upper"] + count["lower"])
    repeats = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return [
        np.log1p(len(raw)), np.log1p(len(w)), np.log1p(len(lines)), len(raw) / total, kinds / total, max(found.values(), default=0) / total,
        repeats / total, count["upper"] / letters, *(count[k] / n for k in ("digit", "blank", "line", "stop", "shout", "pipe", "sign", "control", "high")),
        len(set(lines)) / max(1, len(lines)), max(map(len, lines), default=0) / n, max(map(len, w), default=0) / n,
        sum(x[-1:] in b".!?" for x in w) / total, sum(len(x) == 1 for x in w) / total, sum(x[:4] == b"http" or b"@" in x for x in w) / total,
    ], found


WIDTH = len(statistics(None)[0])


class Model(NamedTuple):
    edges: np.ndarray
    machine: Machine


def features(edges: np.ndarray, stats: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bin of each statistic, and the hashed words of unit length together."""
    bins = (stats[:, None] > edges).sum(1) + np.arange(WIDTH) * (BINS + 1)
    index = np.concatenate([[0], 1 + bins, 1 + WIDTH * (BINS + 1) + bucket])
    return index, np.concatenate([[1.0], np.full(WIDTH, 0.3), np.full(len(bucket), 1 / max(1, len(bucket)) ** 0.5)])


def buckets(found: dict[bytes, int]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(x) % BUCKETS for x in found), np.int64, len(found)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text). Fitted on a bounded sample of labelled rows that are not held out."""

    @F.pandas_udf("stats binary, bucket binary")
    def extract(texts: pd.Series) -> pd.DataFrame:
        rows = (statistics(t) for t in texts)
        return pd.DataFrame([(np.array(s, np.float64).tobytes(), buckets(f).astype(np.int16).tobytes()) for s, f in rows], columns=["stats", "bucket"])

    sample = labelled_sample(docs, labels, "quality")
    rows = sample.select("label", extract("text").alias("f")).select("label", "f.*").toPandas()  # bounded: labelled.SAMPLE
    stats = np.frombuffer(b"".join(rows["stats"])).reshape(-1, WIDTH)
    edges = np.quantile(stats, (np.arange(BINS) + 0.5) / BINS, axis=0).T if len(stats) else np.zeros((WIDTH, BINS))
    made = (features(edges, s, np.frombuffer(b, np.int16).astype(np.int64)) for s, b in zip(stats, rows["bucket"], strict=True))
    made = [(i.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for i, v in made]
    x = pack_bytes([i for i, _ in made], [v for _, v in made])
    gold = rows["label"].to_numpy(float) if len(rows) else np.empty(0)
    return Model(edges, fit(x, gold, 1 + WIDTH * (BINS + 1) + BUCKETS, RANK))


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for a in range(0, len(texts), 512):
            rows = [statistics(t) for t in texts[a : a + 512]]
            out.append(predict(m.machine, pack([features(m.edges, np.array(s), buckets(f)) for s, f in rows])))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Null texts count as empty ones. Without labelled rows every score is a half. Repeated rows and null ids give one row
    each; further columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    model = train(docs, labels)
    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score_column(docs, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
