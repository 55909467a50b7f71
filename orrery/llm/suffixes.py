"""Operator 6, benchmark decontamination: suffix arrays over shards of the training words, searched for test suffixes.

Each Arrow batch of documents is a shard. Its suffix array orders the word positions at which some test suffix could
begin; every test suffix is found in it by binary search, with the longest verbatim match and all places. The test side
goes to the workers in blocks of bounded size, one pass over the documents for each; with one block nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import keep, plain

#: Bytes of test text that one pass holds on each worker; a larger test table takes more passes.
BLOCK_BYTES = 16 << 20
#: Words of a shard whose suffixes are sorted together.
SHARD_WORDS = 1 << 20

_letters = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_letters).split() if text else []


class Tests(NamedTuple):
    """Test suffixes: word numbers (1..), all items' words with a 0 after each, start of each suffix, its item, the words wanted there."""

    number: dict[bytes, int]
    stream: np.ndarray
    start: np.ndarray
    item: np.ndarray
    want: np.ndarray
    ids: list[str | None]


def test_suffixes(items: list[tuple[int | None, str | None]], window: int) -> Tests:
    number: dict[bytes, int] = {}
    stream, start, item, want = [], [], [], []
    for k, (_, text) in enumerate(items):
        w = [number.setdefault(x, len(number) + 1) for x in item_words(text)]
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            start.append(len(stream) + i)
            item.append(k)
            want.append(size)
        stream += [*w, 0]
    a = lambda x: np.array(x, np.int64)
    return Tests(number, np.array(stream + [0] * window, np.int32), a(start), a(item), a(want), [None if i is None else str(i) for i, _ in items])


def keys(stream: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` words from each place, as byte strings in the order of the word numbers (0 ends a suffix)."""
    rows = stream[np.minimum(at[:, None] + np.arange(length), len(stream) - 1)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * length}").ravel()


def shard_matches(tests: Tests, stream: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, place) for every place in the shard where a test suffix agrees on all the words wanted of it."""
    none = np.empty(0, np.int64)
    if not len(tests.start):
        return none, none
    base = np.int64(len(tests.number) + 1)
    after = np.append(stream[1:], 0).astype(np.int64)
    pair = stream * base + after
    first, second = tests.stream[tests.start], tests.stream[tests.start + 1]
    short = tests.want < 2
    opens = np.isin(pair, np.unique(first[~short] * base + second[~short])) if (~short).any() else np.zeros(len(stream), bool)
    if short.any():
        opens |= np.isin(stream, np.unique(first[short]))
    at = np.flatnonzero(opens & (stream > 0))
    own = keys(stream, at, window)
    order = np.argsort(own, kind="stable")  # the suffix array of the places that can begin a match
    at, own = at[order], own[order]
    suffix, place = [], []
    for size in np.unique(tests.want):
        these = np.flatnonzero(tests.want == size)
        cut = own if size == window else np.ascontiguousarray(own).view(">u4").reshape(-1, window)[:, :size].copy().view(f"S{4 * size}").ravel()
        asked = keys(tests.stream, tests.start[these], int(size))
        low, high = np.searchsorted(cut, asked, "left"), np.searchsorted(cut, asked, "right")
        n = high - low
        suffix.append(np.repeat(these, n))
        place.append(at[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(suffix), np.concatenate(place)


def longest(tests: Tests, stream: np.ndarray, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Words that agree from each place on: binary search found the wanted ones, this follows the match to its end."""
    length, live = tests.want[suffix].copy(), np.arange(len(suffix))
    while len(live):
        a, b = tests.start[suffix[live]] + length[live], place[live] + length[live]
        same = (a < len(tests.stream)) & (b < len(stream))
        live, a, b = live[same], a[same], b[same]
        same = (tests.stream[a] == stream[b]) & (stream[b] > 0)
        live = live[same]
        length[live] += 1
    return length


def shards(texts: Iterator[str | None], number: dict[bytes, int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(words of each document, their numbers with a 0 after each document) in pieces of about SHARD_WORDS."""
    sizes, parts, held = [], [], 0
    get = number.get
    for text in texts:
        w = item_words(text)
        sizes.append(len(w))
        parts.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
        parts.append(np.zeros(1, np.int32))
        held += len(w)
        if held >= SHARD_WORDS:
            yield sizes, np.concatenate(parts)
            sizes, parts, held = [], [], 0
    if sizes:
        yield sizes, np.concatenate(parts)


def test_blocks(benchmark: DataFrame, window: int) -> Iterator[Tests]:
    """The test table in blocks of at most BLOCK_BYTES of text (or one item); the driver holds one at a time."""
    held, size, none = [], 0, True
    for row in benchmark.toLocalIterator():
        cost = len(row[1] or "") + 16
        if held and size + cost > BLOCK_BYTES:
            yield test_suffixes(held, window)
            held, size, none = [], 0, False
        held.append((row[0], row[1]))
        size += cost
    if held or none:
        yield test_suffixes(held, window)


def scan(text: Column, tests: Tests, window: int, df: DataFrame) -> Column:
    """struct(n_words, n_hit, spans (hit words as runs), items, longest, longest_at) of each document against one block of tests."""
    shared = df.sparkSession.sparkContext.broadcast(tests)

    @F.pandas_udf("n_words long, n_hit long, spans array<int>, items array<string>, longest long, longest_at long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tests = shared.value
        for texts in batches:
            rows = []
            for sizes, stream in shards(texts, tests.number):
                suffix, place = shard_matches(tests, stream, window)
                begins = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
                doc = np.searchsorted(begins, place, "right") - 1
                cover = np.zeros(len(stream) + 1, np.int32)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + tests.want[suffix], -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)])))
                length = longest(tests, stream, suffix, place)
                found = {d: ([], set(), 0, -1) for d in np.unique(doc).tolist()}
                for d, a, b in zip((np.searchsorted(begins, edge[::2], "right") - 1).tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    found[d][0].extend((a - int(begins[d]), b - int(begins[d])))
                for d, k in {*zip(doc.tolist(), tests.item[suffix].tolist(), strict=True)}:
                    found[d][1].add(tests.ids[k])
                order = np.lexsort((place, -length, doc))
                for x in order[np.unique(doc[order], return_index=True)[1]]:
                    d = int(doc[x])
                    found[d] = (*found[d][:2], int(length[x]), int(place[x] - begins[d]))
                for d, n in enumerate(sizes):
                    spans, items, most, where = found.get(d, ((), (), 0, -1))
                    rows.append((n, sum(spans[1::2]) - sum(spans[::2]), list(spans), sorted(i for i in items if i is not None), most, where))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items", "longest", "longest_at"])

    return run(text)


FOUND = "n_words long, n_hit long, items array<string>, longest long, longest_at long"


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """(row, found): each row of ``docs`` as a struct, and struct(n_words, n_hit, items, longest, longest_at) over all blocks of the test table.

    items: ids whose windows occur, sorted as strings; longest: words of the longest verbatim match that holds a whole
    window (0: none) and longest_at its first word's place. Null texts have no words. Items without words take no part;
    an item with a null id marks words but cannot be named; repeated ids are named once. Each further block of the test
    table is a pass of its own, written before the next begins.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text, blocks = F.col(f"row.`{text_col}`"), test_blocks(benchmark, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return rows.select("row", scan(text, block, window, docs).alias("found"))
    rows, parts = keep(rows.withColumn("n", F.monotonically_increasing_id())), None
    for block in chain([block, after], blocks):
        part = keep(rows.select("n", scan(text, block, window, docs).alias("f")))
        parts = part if parts is None else parts.unionByName(part)

    @F.pandas_udf(FOUND)
    def merge(found: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in found:
            hit, end = 0, 0
            for a, b in sorted((int(p["spans"][i]), int(p["spans"][i + 1])) for p in parts for i in range(0, len(p["spans"]), 2)):
                hit, end = hit + max(0, b - max(a, end)), max(end, b)
            best = max(parts, key=lambda p: (p["longest"], -p["longest_at"]))
            rows.append((parts[0]["n_words"], hit, sorted({x for p in parts for x in p["items"]}), best["longest"], best["longest_at"]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "longest", "longest_at"])

    united = parts.groupBy("n").agg(F.collect_list("f").alias("f")).select("n", merge("f").alias("found"))  # a row for each block
    return rows.join(united, "n").select("row", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, longest, longest_at.

    Each input row gives one row, repeated rows and null ids too; null, empty and blank texts have no words and are clean;
    texts of any length are searched whole; an empty test table leaves all clean; further columns are ignored.
    """
    items = benchmark.select(F.col("item_id"), F.col("text"))
    out = plain(docs, id_col, text_col)
    out = with_contamination(out, items, "text", window).select("row.doc_id", "found.*")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at",
    )
