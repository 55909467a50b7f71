"""Operator 12, spelling variants: each word's near words (one code point put in, left out or replaced) and the form that it stands for.

No pair of words is listed. Words that differ by a replacement at one place share all before and all after it: such a
(position, prefix, suffix) group keeps its size and its two most frequent words, and gives every member its number of near
words and the best of them. Words that differ by an insertion meet where the longer one's deletions join the vocabulary.

The vocabulary is sorted once, most frequent first, and numbered; the best near word is then the smallest number. Prefixes
and suffixes are compared by 128-bit hashes that are sums over their places, so a word of n code points costs n short rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, keep, plain

#: Code points of a word and its occurrences, at least; how many times as frequent a form must be; runs in so many lose a code point.
LEAST_LENGTH, LEAST_COUNT, FACTOR, ERROR_EVERY = 5, 3, 2, 97
#: Different words that a task counts before it hands them on; places of words hashed together.
GATHER, PLACES = 200_000, 1 << 18
#: Kinds of keys: a word's own hash, one for each wildcard place, one for each different deletion.
OWN, GAP, CUT = 0, 1, 2
_runs = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % LEAST_LENGTH)


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF of LEAST_LENGTH or more, A-Z in lower case, a byte (Latin-1) for a code point."""
    return _runs.findall(text.encode("latin-1", "replace").lower())


def changed(run: bytes, opening: int) -> bytes:
    """The run as it counts: where ERROR_EVERY divides the crc32 of ``<doc_id>:<run>`` (begun as ``opening``), one code point is left out."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), opening)
    if h % ERROR_EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts of docs (doc_id, text): summed in each task as far as GATHER words go, then over all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in total], dtype=object), "n": np.fromiter(total.values(), np.int64, len(total))})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                opening = zlib.crc32(b":" if pd.isna(doc_id) else b"%d:" % int(doc_id))
                for w, n in Counter(runs_of(text)).items():
                    total[changed(w, opening)] += n
                if len(total) > GATHER:
                    yield flush()
        yield flush()

    found = docs.mapInPandas(run, "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, word, key, key) arrays for some words. A key is two independent sums of a mixed value for each code point and
    place, so those of all wildcard places and deletions come from prefix sums."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(word)) - begin[word]).astype(np.uint64)
    point = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.uint64)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    found: dict[int, list[np.ndarray]] = {OWN: [], GAP: [], CUT: []}
    for s in range(2):
        value = lambda at: scramble((point + np.uint64(1)) * odd[s] ^ scramble(at * odd[s + 2] + odd[s]))  # noqa: B023, E731
        here, moved = value(place), value(place - np.uint64(1))
        before = np.concatenate([[np.uint64(0)], np.cumsum(here, dtype=np.uint64)])
        after = np.concatenate([[np.uint64(0)], np.cumsum(moved, dtype=np.uint64)])
        ends = begin + size
        total = before[ends] - before[begin]
        at = np.arange(len(word))
        length = scramble(size.astype(np.uint64) * odd[s + 2])
        found[OWN].append(scramble(total + length))
        found[GAP].append(scramble(total[word] - here + scramble(place * odd[2 - s] + odd[3])) + length[word])
        cut = before[at] - before[begin[word]] + after[ends[word]] - after[at + 1]
        found[CUT].append(scramble(cut + scramble((size[word] - 1).astype(np.uint64) * odd[s + 2])))
    yield OWN, np.arange(len(words)), *found[OWN]
    yield GAP, word, *found[GAP]
    first = (place == 0) | (point != np.concatenate([[np.uint64(0)], point[:-1]]))  # of a run of one letter, one deletion
    first &= size[word] > LEAST_LENGTH
    yield CUT, word[first], *(k[first] for k in found[CUT])


def key_rows(vocabulary: DataFrame) -> DataFrame:
    """(kind, x, y, id) of the words of a vocabulary (id, word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edge = np.cumsum(batch["word"].str.len().to_numpy()) // PLACES
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(edge)) + 1):
                if not len(part):
                    continue
                ids = batch["id"].to_numpy(np.int64)[part]
                for kind, word, x, y in keys(batch["word"].iloc[part].tolist()):
                    for a in range(0, len(word), PLACES):
                        b = slice(a, a + PLACES)
                        yield pd.DataFrame({"kind": np.int32(kind), "x": x[b].view(np.int64), "y": y[b].view(np.int64), "id": ids[word[b]]})

    return vocabulary.mapInPandas(run, "kind int, x long, y long, id long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best): near words of each word that has any, and the smallest id among them. vocabulary: (id, word), different words."""
    rows = keep(key_rows(vocabulary))
    # words of one gap differ in one code point only, so a group has no more members than there are letters (90)
    groups = rows.filter(F.col("kind") == GAP).groupBy("x", "y").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    groups = groups.select(F.size("ids").alias("size"), F.col("ids")[0].alias("top"), F.col("ids")[1].alias("second"), F.explode("ids").alias("id"))
    replaced = groups.select("id", (F.col("size") - 1).cast("long").alias("k"), F.when(F.col("id") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))
    longer = rows.filter(F.col("kind") == CUT).select("x", "y", F.col("id").alias("longer"))
    met = keep(longer.join(rows.filter(F.col("kind") == OWN).select("x", "y", F.col("id").alias("shorter")), ["x", "y"]).select("longer", "shorter"))
    ways = [met.select(F.col(a).alias("id"), F.lit(1).cast("long").alias("k"), F.col(b).alias("best")) for a, b in (("longer", "shorter"), ("shorter", "longer"))]
    found = keep(replaced.unionByName(ways[0]).unionByName(ways[1]).groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")))
    discard(rows, met)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last form that is reached from each id of ``forms`` (id, form). Every round doubles the steps taken."""
    now = keep(forms.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("on"))
        after = keep(now.join(on, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """One row for each word of ``docs``: word, form, root, n, n_near, form_n.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case, one code point left out where the
    checksum of id and run says so, of LEAST_LENGTH code points or more and ``least_count`` occurrences in all. form: the near
    word with the largest n (ties: the first in code-point order) if its n is at least ``factor`` times the word's, else null; root:
    where forms lead in the end, the word itself if it has none (counts grow from form to form, so there is no ring).
    A null id counts as the empty text in the checksum; null and empty texts have no words; a text or word of any length is
    taken whole; repeated rows count each time; an empty table gives none; further columns are ignored.
    """
    words = keep(word_counts(plain(docs, id_col, text_col)).filter(F.col("n") >= least_count))
    vocabulary = keep(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    discard(words)
    near = near_words(vocabulary.select("id", "word"))
    named = lambda k: vocabulary.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"))
    best = vocabulary.join(near, "id", "left").join(named("best"), "best", "left").withColumn("is_form", F.col("best_n") >= factor * F.col("n"))
    best = keep(best.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_form"), F.col(c)).alias(k) for c, k in (("best", "form_id"), ("best_word", "form"), ("best_n", "form_n"))]))
    ends = roots(best.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    out = best.join(ends, "id", "left").join(named("root").drop("root_n"), "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
