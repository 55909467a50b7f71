"""Operator 2, language-model scoring: a Brown class-based n-gram model, counted, clustered and applied by Spark.

Exchange clustering moves a word to the class that most raises the likelihood of the class bigrams. It exchanges
objects: each of the most frequent words, and a bucket for all rarer words that begin and end alike. Spark counts pairs of
objects over all training text; the driver sees the square of objects only, whose size is fixed, and exchanges on it exactly.
The model: P(word | before) = P(class | two classes before) P(object | class) P(word | object), each factor smoothed, with
one unknown word for each bucket; so the probabilities of all words, the unknown and the end add up to one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, fold, keep, plain, words

#: Words with an object of their own, buckets of all others, classes, rounds of exchange, words that the workers hold
#: with their counts (others are joined), the longest word (bytes) among these, and tokens counted together in a task.
OBJECTS, BUCKETS, CLASSES, ROUNDS, HELD, LONGEST, CHUNK = 2048, 1024, 48, 12, 1 << 17, 64, 1 << 19
END = 0  # object and class of the end token; it is also what comes before a text


class Lexicon(NamedTuple):
    """Training counts of the frequent words, and the object of each of the most frequent."""

    count: dict[bytes, int]
    own: dict[bytes, int]

    def object_of(self, word: bytes) -> int:
        return self.own.get(word) or OBJECTS + 1 + bucket(word)


class Model(NamedTuple):
    lexicon: Lexicon
    tokens: int
    types: int
    texts: int
    discount: float
    class_of: np.ndarray
    in_class: np.ndarray
    transition: np.ndarray
    log_size: np.ndarray
    log_unknown: np.ndarray


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:2] + b" " + word[-2:]) % BUCKETS


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training text; each task combines what it has read before the shuffle."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                count.update(words(text))
                if len(count) > CHUNK:
                    yield pd.DataFrame({"word": count.keys(), "n": count.values()})
                    count = Counter()
        yield pd.DataFrame({"word": list(count.keys()), "n": np.fromiter(count.values(), np.int64, len(count))})

    return train.select("text").mapInPandas(emit, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(vocabulary: DataFrame) -> Lexicon:
    """The words above the lowest count level (sixteenths of a doubling) at which at most HELD words remain."""
    short = vocabulary.filter(F.length("word") <= LONGEST).withColumn("level", F.floor(F.log2("n") * 16))
    left, edge = HELD, None
    for r in sorted(short.groupBy("level").count().collect(), reverse=True):  # some hundred rows
        left -= r["count"]
        if left < 0:
            break
        edge = r.level
    rows = [] if edge is None else short.filter(F.col("level") >= edge).select("word", "n").collect()  # HELD at most
    count = {bytes(r.word): r.n for r in rows}
    first = sorted(count, key=lambda w: (-count[w], w))[:OBJECTS]
    return Lexicon(count, {w: i + 1 for i, w in enumerate(first)})


def sequences(batches: Iterator[pd.DataFrame], lex: Lexicon) -> Iterator[list[np.ndarray]]:
    """Objects of whole texts with the end on both sides, in lists of about CHUNK tokens."""
    held, size, own = [], 0, lex.own
    for batch in batches:
        for text in batch["text"]:
            w = words(text)
            held.append(np.array([END, *[own.get(x) or OBJECTS + 1 + zlib.crc32(x[:2] + b" " + x[-2:]) % BUCKETS for x in w], END], np.int32))
            size += len(w)
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def object_pairs(train: DataFrame, lex: Lexicon) -> DataFrame:
    """(a, b, n): how often object b follows a."""
    shared, base = train.sparkSession.sparkContext.broadcast(lex), OBJECTS + BUCKETS + 1

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in sequences(batches, shared.value):
            key, n = np.unique(np.concatenate([s[:-1] * np.int32(base) + s[1:] for s in held]), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n.astype(np.int64)})

    pairs = train.select("text").mapInPandas(emit, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return pairs.select(F.floor(F.col("key") / base).cast("int").alias("a"), F.pmod("key", F.lit(base)).alias("b"), "n")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def matrix(pairs: DataFrame) -> np.ndarray:
    """The pair counts as a square of objects on the driver: OBJECTS and BUCKETS bound it, whatever the corpus; cells come packed."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": [batch[["a", "b"]].to_numpy(np.int32).tobytes()], "n": [batch["n"].to_numpy(np.int64).tobytes()]})

    n = OBJECTS + BUCKETS + 1
    out = np.zeros((n, n))
    for r in pairs.mapInPandas(emit, "at binary, n binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.int32).reshape(-1, 2)
        out[at[:, 0], at[:, 1]] = np.frombuffer(r["n"], np.int64)
    return out


def exchange(pairs: np.ndarray) -> np.ndarray:
    """The class of each object: each in turn moves to the class that raises the likelihood most, until none moves (ROUNDS at most).

    All contexts follow every move at once, so each move is judged by the classes as they are, and the likelihood never falls.
    """
    n = len(pairs)
    classes = np.array([0] + [1 + i % (CLASSES - 1) for i in range(n - 1)])
    member = np.eye(CLASSES)[classes]
    left, right = pairs.T @ member, pairs @ member  # what is before and after each object, by class
    joint, size = member.T @ right, pairs.sum(0)
    total = np.bincount(classes, size, CLASSES)
    for _ in range(ROUNDS):
        moved = 0
        for o in np.flatnonzero(size[1:] > 0) + 1:
            a, same = classes[o], pairs[o, o]
            lo, ro = left[o].copy(), right[o].copy()
            lo[a], ro[a] = lo[a] - same, ro[a] - same
            joint[a] -= ro
            joint[:, a] -= lo
            joint[a, a] -= same
            total[a] -= size[o]
            own, log = np.diag(joint), xlogx(joint)
            gain = (xlogx(joint + ro) - log).sum(1) + (xlogx(joint.T + lo) - log.T).sum(1)
            gain += xlogx(own + ro + lo + same) + xlogx(own) - xlogx(own + ro) - xlogx(own + lo)
            gain -= 2 * (xlogx(total + size[o]) - xlogx(total))
            gain[END] = -np.inf
            b = int(gain.argmax())
            b = b if gain[b] > gain[a] + 1e-6 else a
            joint[b] += ro
            joint[:, b] += lo
            joint[b, b] += same
            total[b] += size[o]
            if a != b:
                moved += 1
                classes[o] = b
                for side, seen in ((left, pairs[o]), (right, pairs[:, o])):
                    side[:, a] -= seen
                    side[:, b] += seen
        if not moved:
            break
    return classes


def class_trigrams(train: DataFrame, lex: Lexicon, classes: np.ndarray) -> np.ndarray:
    shared = train.sparkSession.sparkContext.broadcast((lex, classes.astype(np.int64)))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, of = shared.value
        count = np.zeros(CLASSES**3, np.int64)
        for held in sequences(batches, lex):
            for s in held:
                c = np.concatenate([[END], of[s]])
                np.add.at(count, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)
        key = np.flatnonzero(count)
        yield pd.DataFrame({"key": key, "n": count[key]})

    count = np.zeros(CLASSES**3)
    rows = train.select("text").mapInPandas(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # CLASSES**3 rows at most
    count[rows["key"]] = rows["n"]
    return count.reshape(CLASSES, CLASSES, CLASSES)


def smooth(three: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b), interpolated with shorter histories by Witten and Bell's weights."""
    two, one = three.sum(0), three.sum((0, 1))
    p = (one + 1) / (one.sum() + CLASSES)
    kinds = np.maximum(1, (two > 0).sum(1, keepdims=True))
    p = (two + kinds * p[None, :]) / (two.sum(1, keepdims=True) + kinds)
    kinds = np.maximum(1, (three > 0).sum(2, keepdims=True))
    return np.log10((three + kinds * p[None, :, :]) / (three.sum(2, keepdims=True) + kinds))


def fit(train: DataFrame, vocabulary: DataFrame) -> Model:
    """train: (text); vocabulary: its count_words, as a written table."""
    lex = lexicon(vocabulary)

    @F.pandas_udf("int")
    def bucket_of(batch: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((bucket(w) for w in batch), np.int32, len(batch)))

    if lex.own:
        level = min(lex.count[w] for w in lex.own)
        own = F.broadcast(vocabulary.sparkSession.createDataFrame([(w,) for w in lex.own], "word binary"))  # OBJECTS rows
        others = vocabulary.filter(F.col("n") < level).unionByName(vocabulary.filter(F.col("n") >= level).join(own, "word", "left_anti"))
    else:
        others = vocabulary
    rows = others.groupBy(bucket_of("word").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("t"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).collect()
    size, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:  # BUCKETS rows at most
        size[r.b], kinds[r.b] = r.n, r.t
    once, twice = sum(r.n1 for r in rows), sum(r.n2 for r in rows)
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    texts = train.count()
    totals = vocabulary.agg(F.sum("n"), F.count("*")).first()
    pairs = keep(object_pairs(train, lex))
    classes = exchange(matrix(pairs))
    discard(pairs)
    of_object = np.zeros(OBJECTS + BUCKETS + 1)
    for w, i in lex.own.items():
        of_object[i] = lex.count[w]
    of_object[OBJECTS + 1 :] = size
    of_object[END] = texts
    mass = of_object + np.where(np.arange(len(of_object)) == END, 0.0, 0.1)
    mass[1 + len(lex.own) : OBJECTS + 1] = 0  # objects without a word
    in_class = np.log10(np.maximum(mass, 1e-300) / np.maximum(np.bincount(classes, mass, CLASSES)[classes], 1e-300))
    in_class[END] = 0.0
    with np.errstate(divide="ignore"):
        log_size = np.where(size > 0, np.log10(np.maximum(size, 1)), 0.0)
        log_unknown = np.where(size > 0, np.log10(np.maximum(discount * kinds, 1e-300)) - log_size, 0.0)
    return Model(lex, (totals[0] or 0) + texts, totals[1] + (texts > 0), texts, discount, classes, in_class, smooth(class_trigrams(train, lex, classes)), log_size, log_unknown)


def apply(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out). Words that the workers do not hold are joined to the vocabulary by word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    floor = model.tokens + 0.1 * (model.types + 1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        number, known, base, own = {}, [], [], []
        for i, (w, c) in enumerate(m.lexicon.count.items()):
            number[w] = i
            o = m.lexicon.object_of(w)
            known.append(o)
            base.append(math.log10((c + 0.1) / floor))
            own.append(m.in_class[o] + (math.log10(c - m.discount) - m.log_size[o - OBJECTS - 1] if o > OBJECTS else 0.0))
        known, base, own = np.array(known, np.int64), np.array(base), np.array(own)
        end = math.log10((m.texts + 0.1) / floor)
        for batch in batches:
            held = {k: [] for k in ("row", "doc_id", "held_out", "word", "times", "bucket", "n_known", "base", "score")}

            def put(*values: object, held: dict = held) -> None:
                for column, v in zip(held.values(), values, strict=True):
                    column.append(v)

            for row, i, text, out in zip(batch["row"].tolist(), batch["doc_id"], batch["text"], batch["held_out"].tolist(), strict=True):
                w = words(text)
                at = np.fromiter((number.get(x, -1) for x in w), np.int64, len(w))
                miss = np.flatnonzero(at < 0)
                new = Counter(w[k] for k in miss.tolist())
                of = {x: bucket(x) for x in new}
                objects = known[at] if len(known) else np.zeros(len(w), np.int64)
                objects[miss] = [OBJECTS + 1 + of[w[k]] for k in miss.tolist()]
                c = np.concatenate([[END, END], m.class_of[objects], [END]])
                hit = at[at >= 0]
                score = m.transition[c[:-2], c[1:-1], c[2:]].sum() + own[hit].sum() + m.in_class[objects[miss]].sum()
                doc = None if pd.isna(i) else int(i)
                put(row, doc, out, b" %d" % row, len(w) + 1, -1, len(hit) + (m.texts > 0), float(base[hit].sum() + end), float(score))
                for x, times in new.items():
                    put(row, None, None, x, times, of[x], 0, 0.0, 0.0)
                if len(held["row"]) > CHUNK:
                    yield frame(held)
                    for column in held.values():
                        column.clear()
            yield frame(held)

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame({**held, "doc_id": pd.array(held["doc_id"], "Int64"), "held_out": pd.array(held["held_out"], "boolean")})

    kind = "row long, doc_id long, held_out boolean, word binary, times long, bucket int, n_known long, base double, score double"
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(emit, kind)
    joined = rows.join(vocabulary.select("word", "n"), "word", "left")
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    of = lambda xs: F.element_at(array(xs), F.col("bucket") + 1)
    n, times, direct = F.col("n"), F.col("times"), F.col("bucket") < 0
    joined = joined.select(
        "row", "doc_id", "held_out",
        F.when(direct, times).otherwise(0).alias("n_tokens"),
        F.when(direct, F.col("n_known")).when(n.isNotNull(), times).otherwise(0).alias("n_known"),
        F.when(direct, F.col("base")).otherwise(times * F.log10((F.coalesce(n, F.lit(0)) + 0.1) / F.lit(floor))).alias("base"),
        F.when(direct, F.col("score")).when(n.isNull(), times * of(model.log_unknown)).otherwise(times * (F.log10(n - model.discount) - of(model.log_size))).alias("score"),
    )
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def lm_scores(docs: DataFrame, held_out: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from the documents whose crc32(doc_id as text) modulo ``held_out`` is not 0. A text's tokens are its words and
    one end. Null and blank texts are an end only. Repeated rows and null ids give one row each (and count as often);
    further columns are ignored. Without training text every word is unknown.
    """
    docs = plain(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), held_out) == 0)
    train = docs.filter(~F.col("held_out")).select("text")
    vocabulary = keep(count_words(train))
    return apply(docs, fit(train, vocabulary), vocabulary)
