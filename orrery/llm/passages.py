"""Operator 4, substring deduplication: compact windows over min-hashes of word shingles find near-duplicate passages.

For a hash function, all subsequences of a block of text that have their minimum at one place form a compact window:
a node of the Cartesian tree of the hash values; its minimum is the key of all those subsequences. A window of 50 words
(46 shingles) that is SIMILAR to another has 41 shingles in common with it, so one changed word within it at most, and
25 words of it are in the other verbatim. All subsequences of 25 words or more are therefore grouped by the least of
their 13-word grams: what is similar shares a key with certainty.

Verbatim passages need no comparing: the nodes that span 50 words or more hold every window of 50 words, and the hash of
all words that a node's windows cover tells which documents have the same; only different surroundings of one key
are looked at window by window. For edited passages, a key's holders are compared with the first of them (windows of a pair of
documents are joined as intervals on like diagonals, and the stretches are verified word hash by word hash). Where a
holder is unlike the first, the key's other holders go on without it. The different surroundings of a key are then compared in
one go, by blocks, all those of unlike classes, if up to DEALT are outside its largest class. Of keys with more, two holders
that are alike have a shingle near the key that the first lacks, and it is among the nearest six on its side for both, as one
changed word spoils five at most. That shingle and the key make the key of the next round. No other first document's shingles
are taken away, so none can hide a pair. A key ends when its holders are one class, or one is left; a line that very many unlike documents hold ends at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, keep, plain, words
from orrery.llm.components import components

#: Words of a shingle, of the shortest passage, of a block and of what it shares with the next; the similarity of passages
#: (Jaccard, shingles); words that a task looks at together; bytes hashed together.
SHINGLE, MIN_WORDS, BLOCK, OVERLAP, SIMILAR, CHUNK, PIECE = 5, 50, 1024, 128, 0.8, 1 << 17, 1 << 20
LEAST = MIN_WORDS - SHINGLE + 1
#: Shingles that two windows of LEAST shingles each have in common at the least, if they are SIMILAR.
SHARED = int(np.ceil(LEAST * 2 * SIMILAR / (1 + SIMILAR) - 1e-9))
#: So many of a window's shingles hold one at the least that any window like it has.
RARE = LEAST - SHARED + 1
#: Words of a gram, grams of the least subsequence, hash functions (one is enough: any 25 words in common share their minimum).
GRAM, SPAN, FUNCTIONS = 13, 13, 1
#: Words looked at beside a common subsequence, which may lie at the end of a similar window.
BESIDE = MIN_WORDS - GRAM - SPAN + 1 + SHINGLE
#: Grams of a window of MIN_WORDS; shingles on either side of a key that may join it: one changed word spoils SHINGLE of them.
WHOLE, NEAREST = MIN_WORDS - GRAM + 1, SHINGLE + 1
#: Words beside a key that are its surroundings; different ones of a key in one block, and those outside its largest class
#: that are compared in one go, at the most.
AROUND, TOGETHER, DEALT = 64, 4096, 1 << 16
#: Places in a row that have a common shingle within reach, where common shingles make up MIN_WORDS words.
CHAIN = MIN_WORDS + SHINGLE + 1
_odd = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of the ``width`` words from each place; the last places, where words are lacking, are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _odd + hashes[i : i + n]
    return mix(out)


def compact_windows(values: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, least_span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(block, l, c, r) of the nodes of each block's Cartesian tree that span ``least_span`` places or more, from the root down.

    ``low`` to ``high`` are the places of each block. The last bits of each value give way to its place, times an odd number so
    that ties are broken evenly. A table of the smallest value in every stretch of a power of two then finds the root of
    any range; both sides of it are ranges again.
    """
    bits = len(values).bit_length()
    rest, odd = np.uint64((1 << bits) - 1), 0x9E3779B1
    back = np.uint64(pow(odd, -1, 1 << bits))
    marked = values & ~rest | np.arange(len(values), dtype=np.uint64) * np.uint64(odd) & rest
    size, width = int((high - low).max(initial=0)) + 1, len(values)
    table = [marked]
    while 2 << (len(table) - 1) <= size:
        step, last = 1 << (len(table) - 1), table[-1]
        table.append(np.concatenate([np.minimum(last[:-step], last[step:]), last[-step:]]))
    log = np.frexp(np.arange(size + 1))[1] - 1
    flat = np.concatenate(table)
    out = []
    while True:
        wide = high - low + 1 >= least_span
        low, high, block = low[wide], high[wide], block[wide]
        if not len(low):
            break
        k = log[high - low + 1]
        least = np.minimum(flat[k * width + low], flat[k * width + high - (1 << k) + 1])
        c = ((least & rest) * back & rest).astype(np.int64)
        out.append((block, low, c, high))
        low, high, block = np.concatenate([low, c + 1]), np.concatenate([c - 1, high]), np.concatenate([block, block])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def blocks(end: int) -> Iterator[tuple[int, int]]:
    """First and last gram of the blocks of ``end`` words; every MIN_WORDS words lie within one."""
    if end >= MIN_WORDS:
        for s in range(0, max(1, end - OVERLAP), BLOCK - OVERLAP):
            yield s, min(s + BLOCK, end) - GRAM


def windows(hashes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(document, key, first gram, grams, place of the minimum, hash of all words around) of the compact windows of some documents.

    The last is that of the words of all windows of MIN_WORDS words that have this minimum, and of their place (0: there are none).
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    begin = np.cumsum(sizes) - sizes
    found = [(int(begin[d]) + l, int(begin[d]) + r, d) for d, n in enumerate(sizes.tolist()) for l, r in blocks(n)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64)
    low, high, doc = (np.array(x, np.int64) for x in zip(*found, strict=True))
    flat = np.concatenate([*hashes, np.zeros(GRAM, np.uint64)])
    grams, total = shingles(flat, GRAM), prefixes(flat)
    out, block = [], np.arange(len(low))
    for k in range(FUNCTIONS):
        value = mix(grams + np.uint64((k + 1) * int(_odd) % (1 << 64)))
        at, l, c, r = compact_windows(value, low, high, block)
        d = doc[at]
        first, last = np.maximum(l, c - WHOLE + 1), np.minimum(c, r - WHOLE + 1)
        around = np.zeros(len(l), np.uint64)
        wide = np.flatnonzero(r - l + 1 >= WHOLE)
        x, y = first[wide], last[wide] + MIN_WORDS
        around[wide] = mix(between(total, x, y) + (c[wide] - x).astype(np.uint64) * _odd + (y - x).astype(np.uint64)) | np.uint64(1)
        out.append((d, value[c], l - begin[d], r - l + 1, c - begin[d], around))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prefixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``between`` takes the hash of any run of words, and the powers that it needs."""
    power, inverse = powers(len(hashes) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + _odd) * power[: len(hashes)], dtype=np.uint64)]), inverse


def between(total: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (total[0][end] - total[0][start]) * total[1][start]


def joined_keys(h: np.ndarray, asks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of a document's next round. asks: keys at places (``held``) that led to one first document, and the runs of
    shingles that this one has (``masks``). Each key is joined with the NEAREST shingles on either side that the first lacks;
    where the first has all that a similar window needs and yet is unlike, the key goes on by itself too."""
    g, places, found = shingles(h), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for ask in asks:
        seen = np.zeros(len(g) + 1, bool)
        for m in ask["masks"] if ask["masks"] is not None else ():
            seen[m["start"] : m["end"]] = True
        free = np.flatnonzero(~seen[:-1])
        total = np.concatenate([[0], np.cumsum(seen[:-1])])
        c = np.array([x["place"] for x in ask["held"]], np.int64)
        key = np.array([x["key"] for x in ask["held"]], np.int64).view(np.uint64)
        at = np.searchsorted(free, c)
        for step in range(-NEAREST, NEAREST):
            k = at + step
            good = np.flatnonzero((k >= 0) & (k < len(free)))
            s = free[k[good]]
            near = (s >= c[good] + GRAM - MIN_WORDS) & (s <= c[good] + MIN_WORDS - SHINGLE)
            good, s = good[near], s[near]
            places.append(c[good])
            found.append(mix(key[good] * _odd + g[s]))
        begin = np.clip(c[:, None] + np.arange(GRAM - MIN_WORDS, 1)[None, :], 0, max(0, len(g) - LEAST))
        held = (total[np.minimum(begin + LEAST, len(g))] - total[begin]).max(1, initial=0) >= SHARED
        places.append(c[held])
        found.append(mix(key[held] + _odd))
    place, key = np.concatenate(places), np.concatenate(found)
    once = np.unique(mix(place.view(np.uint64) * _odd ^ key), return_index=True)[1]
    return place[once], key[once]


def similar_spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end) of words of ``a`` made up of windows of MIN_WORDS words that have a SIMILAR window in ``b``; those of ``b`` likewise;
    and the runs of shingles of ``a`` that ``b`` has."""
    none = np.empty((0, 2), np.int64)
    if min(len(a), len(b)) < SHINGLE:
        return none, none, none
    if np.array_equal(a, b) and len(a) >= MIN_WORDS:
        return np.array([[0, len(a)]]), np.array([[0, len(a)]]), np.array([[0, len(a) - SHINGLE + 1]])
    different, number = np.unique(np.concatenate([shingles(a), shingles(b)]), return_inverse=True)
    x, y = number[: len(a) - SHINGLE + 1], number[len(a) - SHINGLE + 1 :]

    def held(other: np.ndarray) -> np.ndarray:
        there = np.zeros(len(different), bool)
        there[other] = True
        return there

    def covered(x: np.ndarray, other: np.ndarray) -> np.ndarray:
        mark = held(other)[x]
        total = np.concatenate([[0], np.cumsum(mark)])
        good = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= SHARED)
        edge = np.zeros(len(x) + 1, np.int64)
        edge[good] += 1
        edge[good + LEAST] -= 1
        return (np.cumsum(edge[:-1]) > 0) & mark

    common = np.flatnonzero(np.diff(np.concatenate([[0], held(y)[x].view(np.int8), [0]]))).reshape(-1, 2)
    if min(len(a), len(b)) < MIN_WORDS:
        return none, none, common
    here, there = covered(x, y), covered(y, x)
    return runs(covered(x, y[there]), len(a)), runs(covered(y, x[here]), len(b)), common


def runs(here: np.ndarray, n: int) -> np.ndarray:
    """Runs of MIN_WORDS words or more, of n, that the marked shingles make up."""
    word = np.zeros(n + 2, np.int8)
    for i in range(SHINGLE):
        word[1 + i : 1 + i + len(here)] |= here.view(np.int8)
    joined: list[list[int]] = []
    for s, e in np.flatnonzero(np.diff(word)).reshape(-1, 2).tolist():  # single changed words within a passage belong to it
        if joined and s - joined[-1][1] <= SHINGLE:
            joined[-1][1] = e
        else:
            joined.append([s, e])
    return np.array([r for r in joined if r[1] - r[0] >= MIN_WORDS], np.int64).reshape(-1, 2)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums over the whole text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_blanks) if text else b""
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.rfind(b" ", at, at + PIECE) + 1 or raw.find(b" ", at) + 1 or len(raw)
        end = end if end > at else raw.find(b" ", at) + 1 or len(raw)
        data = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.concatenate([[0], (data != 32).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(inside))
        power, inverse = powers(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_byte[data] * power[: len(data)], dtype=np.uint64)])
        out.append(mix((total[edge[1::2]] - total[edge[::2]]) * inverse[edge[::2]]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


_blanks = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_byte = mix(np.arange(1, 257, dtype=np.uint64) * _odd)
_base = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        tables = []
        for base in (_base, pow(_base, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > PIECE:
            return tables[0], tables[1]
        _powers[size] = tables[0], tables[1]
    return _powers[size]


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.hash(text)


WINDOW = "doc_id long, mark int, at long, key long, around long"


def find_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at, key, around): at packs the first gram, the grams and the place of the minimum after the first.

    docs: (doc_id, text, mark), whole texts; or with ``asks`` too: then keys of an earlier round, each joined with a shingle near it.
    """
    again = "asks" in docs.columns

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(ids: list, marks: list, d: np.ndarray, at: np.ndarray, key: np.ndarray, around: np.ndarray) -> pd.DataFrame:
            number = np.array([0 if i is None else i for i in ids], np.int64)
            lacks = np.array([i is None for i in ids], bool)
            return pd.DataFrame({
                "doc_id": pd.arrays.IntegerArray(number[d], lacks[d]), "mark": np.array(marks, np.int32)[d], "at": at, "key": key.view(np.int64), "around": around.view(np.int64)
            })

        def flush(held: list[tuple]) -> pd.DataFrame:
            ids, marks, hashes = zip(*held, strict=True)
            d, key, l, n, c, around = windows(list(hashes))
            return table(ids, marks, d, l << 22 | n << 11 | (c - l), key, around)

        for batch in batches:
            held, size = [], 0
            for k, (i, mark, text) in enumerate(zip(batch["doc_id"], batch["mark"], batch["text"], strict=True)):
                h = word_hashes(text)
                if len(h) < MIN_WORDS:
                    continue
                i = None if pd.isna(i) else int(i)
                if again:
                    place, key = joined_keys(h, batch["asks"].iloc[k])
                    yield table([i], [mark], np.zeros(len(place), np.int64), place << 22 | 1 << 11, key, np.zeros(len(place), np.uint64))
                    continue
                held.append((i, mark, h))
                size += len(h)
                if size > CHUNK:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return docs.mapInPandas(emit, WINDOW)


def merged(spans: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Runs that overlap, or lie no more than ``gap`` apart, become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + gap:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def whose(doc_id: str = "doc_id", mark: str = "mark") -> Column:
    """A number for each document."""
    return F.xxhash64(doc_id, mark)


def shared_windows(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The windows (a written table) whose keys documents of several classes (node, component; others stand alone) have.

    Keys are counted before windows are shuffled.
    """
    def named(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("node", whose())
        if classes is None:
            return rows.withColumnRenamed("node", "class")
        return rows.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("node", "component")

    # a later round's keys are few: they are written; those of whole texts are made twice
    if classes is not None:
        windows_of = keep(named(find_windows(docs)))
        several = keep(windows_of.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key"))
        met = keep(windows_of.join(several, "key"))
        discard(several, windows_of)
        return met
    several = named(find_windows(docs)).groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key")
    several = keep(several)
    met = keep(named(find_windows(docs).join(several, "key")))
    discard(several)
    return met


def merge(batch: pd.Series) -> pd.Series:
    """Windows of two documents that overlap on like diagonals become one stretch: a to b here, c to d there (words, to 64s)."""
    out = []
    for pairs in batch:
        rows = np.array([(p["at"], p["first_at"]) for p in pairs], np.int64)
        l, n, c = rows >> 22, rows >> 11 & 0x7FF, rows & 0x7FF
        slant = (l + c)[:, 0] - (l + c)[:, 1]
        found: list[list[int]] = []
        for k in np.lexsort((l[:, 0], slant)).tolist():
            own = [int(l[k, 0]), int(l[k, 0] + n[k, 0]), int(l[k, 1]), int(l[k, 1] + n[k, 1]), int(slant[k])]
            last = found[-1] if found else None
            if last and own[4] - last[4] <= 64 and own[0] <= last[1] + 64 and last[0] <= own[1] + 64:
                found[-1] = [min(last[0], own[0]), max(last[1], own[1]), min(last[2], own[2]), max(last[3], own[3]), own[4]]
            else:
                found.append(own)
        beside = BESIDE if (n > 1).any() else MIN_WORDS  # a key by itself may lie at either end
        down, up = lambda x: max(0, x - beside) // 64 * 64, lambda x: -(-(x + GRAM + beside) // 64) * 64
        out.append([{"a": down(a), "b": up(b), "c": down(c), "d": up(d)} for a, b, c, d, _ in found])
    return pd.Series(out, dtype=object)


def same(x: str, y: str) -> Column:
    """Rows of x and y (aliases) are of one document."""
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.mark") == F.col(f"{y}.mark"))


ENDS = ["doc_id", "mark", "first_id", "first_mark"]
SPAN_LIST = "array<struct<start: int, end: int>>"
_l, _c = "shiftright(at, 22)", "(shiftright(at, 22) + (at & 2047))"
#: The first and the last window of MIN_WORDS words of a node; places are words.
_whole = f"shiftright(at, 11) & 2047 >= {WHOLE}"
_from, _to = f"cast(greatest({_l}, {_c} - {WHOLE - 1}) AS int)", f"cast(least({_c}, {_l} + (shiftright(at, 11) & 2047) - {WHOLE}) AS int)"


def repeats(docs: DataFrame) -> DataFrame:
    """Verified passages (a written table): doc_id, mark, start, end (words), first_id, first_mark: who had it earlier.

    docs: (doc_id, text). Rows grow with the documents that hold a passage, not with their pairs. Every verbatim passage is
    paired with the first document (smallest doc_id) that has it. Similar ones are paired with the first holder of a key, with the
    first of unlike class that is alike among few holders, or with one holder of a key of a later round, until documents that are alike are in one class. (A holder that has a key at several places is
    compared at the first of them; a passage that is edited, and not verbatim, at a later one only, meets by its other keys.)
    """
    docs = docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    met, texts, found, classes = shared_windows(docs), docs, [], None
    while True:
        out, entries, masks = compared(texts, met, not found)
        found.append(out)
        discard(met, texts)
        near, asks, classes = going_on(docs, entries, masks, out, classes)
        found += [near] if near is not None else []
        discard(entries, masks)
        if asks is None:
            break
        texts = keep(docs.alias("d").join(asks.alias("a"), same("d", "a")).select("d.*", "a.asks"))  # few, so later rounds read few texts
        met = shared_windows(texts, classes)
        discard(asks)
        if met.isEmpty():
            discard(met, texts, classes)
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = keep(every.distinct())
    discard(*found)
    return every


def ended(x: str, y: str) -> Column:
    """Rows of x and y (aliases) are of one document and one first document."""
    first = F.col(f"{x}.first_id").eqNullSafe(F.col(f"{y}.first_id")) & (F.col(f"{x}.first_mark") == F.col(f"{y}.first_mark"))
    return same(x, y) & first


def first_of() -> dict[str, Column]:
    """The first holder, and whether there is a holder in another document."""
    return {"first": F.min(F.struct("doc_id", "mark", "at")), "several": F.min(whose()) != F.max(whose())}


def later(rows: DataFrame) -> DataFrame:
    """Rows with a ``first``, but for those of the first's own document."""
    rows = rows.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))))
    return rows.withColumns({"first_id": F.col("first.doc_id"), "first_mark": F.col("first.mark"), "first_at": F.col("first.at")}).drop("first")


def united(rows: DataFrame) -> DataFrame:
    """(ENDS, start, end): runs of a document that overlap, with one first document, become one."""
    rows = rows.groupBy(*ENDS).agg(F.collect_set(F.struct("start", "end")).alias("r"))
    return rows.select(*ENDS, F.explode(F.pandas_udf(unite, SPAN_LIST)("r")).alias("s")).select(*ENDS, "s.*")


def compared(docs: DataFrame, met: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, entries, masks), written tables: verified passages of each key's holders with its first one (``whole``: and verbatim ones);
    keys with a holder that is unlike (ENDS, place, key); the runs of shingles that documents have in common with first ones (ENDS, m)."""
    alike = None
    if whole:
        nodes = met.filter(_whole).select("doc_id", "mark", "at", "key", "around")
        groups = keep(nodes.groupBy("key", "around").agg(*[c.alias(k) for k, c in first_of().items()]))
        alike = later(nodes.join(groups.filter("several").drop("several"), ["key", "around"]))
        alike = keep(united(alike.select(*ENDS, F.expr(_from).alias("start"), F.expr(f"{_to} + {MIN_WORDS}").alias("end"))))
        # one holder of each different surrounding of a key is looked at window by window
        unlike = groups.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        looked = groups.join(unlike, "key", "left_semi").select("first.*", "key")
        looked = keep(looked.selectExpr("doc_id", "mark", "key", f"{_from} AS lo", f"{_to} + 1 AS hi"))
        discard(groups)

    # later, one holder of the class that has the fewest: a class of one is done with after one round, however many it meets
    by_class = met.groupBy("key", "class").agg(first_of()["first"].alias("first"), F.when(F.lit(whole), 0).otherwise(F.count("*")).alias("n"))
    first = keep(by_class.groupBy("key").agg(F.min(F.struct("n", "first"))["first"].alias("first")))
    pairs = later(met.select("doc_id", "mark", "at", "key").join(first, "key"))
    place = F.expr(_c)
    if whole:  # what is the same as at the first holder is known already
        pairs = pairs.alias("o").join(alike.alias("v"), ended("o", "v") & (place >= F.col("v.start")) & (place + GRAM <= F.col("v.end")), "left_anti")
    pairs = keep(pairs)
    near = pairs.groupBy(*ENDS, F.shiftright("at", 34).alias("part")).agg(F.collect_set(F.struct("at", "first_at")).alias("p"))
    stretches = near.select(*ENDS, F.explode(F.pandas_udf(merge, "array<struct<a: int, b: int, c: int, d: int>>")("p")).alias("s"))
    stretches = keep(stretches.select(*ENDS, "s.*").distinct())

    # of each document its own side of every stretch, once each side that others are compared with, and what is looked at by windows
    none = {k: F.lit(None).cast(t) for k, t in (("first_id", "long"), ("first_mark", "int"), ("c", "int"), ("d", "int"), ("key", "long"))}

    def asking(rows: DataFrame, kind: int, lo: str, hi: str, doc_id: str = "doc_id", mark: str = "mark", **fields: str) -> DataFrame:
        rest = [F.col(fields[k]).alias(k) if k in fields else v.alias(k) for k, v in none.items()]
        r = F.struct(F.lit(kind).alias("kind"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), *rest)
        return rows.select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("mark"), r.alias("r"))

    asked = asking(stretches, 0, "a", "b", first_id="first_id", first_mark="first_mark", c="c", d="d")
    asked = asked.union(asking(stretches.select("first_id", "first_mark", "c", "d").distinct(), 1, "c", "d", "first_id", "first_mark"))
    if whole:
        asked = asked.union(asking(looked, 2, "lo", "hi", key="key"))
    asked = keep(asked.groupBy("doc_id", "mark").agg(F.collect_set("r").alias("asked")))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for text, asks in zip(texts, asked, strict=True):
            h = word_hashes(text)
            slim, total, mine = h.astype(np.uint32), prefixes(h), []
            for r in asks:
                if r["kind"] == 2:
                    p = np.arange(r["lo"], r["hi"])
                    mine.append(between(total, p, p + MIN_WORDS).tobytes())
                else:
                    mine.append(slim[r["lo"] : r["hi"]].tobytes())
            out.append(mine)
        return pd.Series(out, dtype=object)

    held = docs.select("doc_id", "mark", "text").alias("d").join(asked.alias("q"), same("d", "q")).select("d.doc_id", "d.mark", "q.asked", cut("d.text", "q.asked").alias("words"))
    held = keep(held.select("doc_id", "mark", F.explode(F.arrays_zip("asked", "words")).alias("w")).select("doc_id", "mark", "w.asked.*", "w.words"))

    @F.pandas_udf(f"here {SPAN_LIST}, there {SPAN_LIST}, common {SPAN_LIST}, open boolean")
    def verify(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            here, there, common = similar_spans(np.frombuffer(p, np.uint32).astype(np.uint64), np.frombuffer(q, np.uint32).astype(np.uint64))
            if not len(here) or not len(there):
                here = there = here[:0]
            beside = any(not any(s <= a and b <= e for s, e in here.tolist()) for a, b in common.tolist())
            out.append([*([{"start": s, "end": e} for s, e in spans.tolist()] for spans in (here, there, common)), beside])
        return pd.DataFrame(out, columns=["here", "there", "common", "open"])

    # a struct of null and other fields equals another of the same; rows that repeat have one second side between them
    side = lambda *columns: F.struct(*[F.col(c).alias(n) for c, n in zip(columns, ("i", "m", "lo", "hi"), strict=True)]).alias("side")
    x = held.filter("kind = 0").select(*ENDS, F.col("lo").alias("a"), "c", F.col("words").alias("x"), side("first_id", "first_mark", "c", "d"))
    y = held.filter("kind = 1").select(side("doc_id", "mark", "lo", "hi"), F.col("words").alias("y")).dropDuplicates(["side"])
    both = keep(x.join(y, "side").select(*ENDS, "a", "c", verify("x", "y").alias("v")).select(*ENDS, "a", "c", "v.*"))
    runs_in = lambda spans, at: (F.explode(spans).alias("h"), F.col(at).alias("base"))
    is_later = F.struct("doc_id", "mark") > F.struct("first_id", "first_mark")  # a null id comes before all others
    turned = [F.col(y).alias(x) for x, y in zip(ENDS, [*ENDS[2:], *ENDS[:2]], strict=True)]
    out = both.filter(is_later).select(*ENDS, *runs_in("here", "a")).union(both.filter(~is_later).select(*turned, *runs_in("there", "c")))
    out = out.select(*ENDS, (F.col("base") + F.col("h.start")).alias("start"), (F.col("base") + F.col("h.end")).alias("end"))
    if whole:
        each = keep(each_window(held.filter("kind = 2").select("doc_id", "mark", "key", "lo", "words")))
        groups = each.groupBy("key", "h").agg(*[c.alias(k) for k, c in first_of().items()]).filter("several").drop("several")
        more = later(each.join(groups, ["key", "h"])).select(*ENDS, F.col("at").cast("int").alias("start"), (F.col("at") + MIN_WORDS).cast("int").alias("end"))
        out = out.unionByName(united(more)).unionByName(alike)
    out = keep(out.distinct())

    o = pairs.alias("o").join(both.filter("open").select(*ENDS).distinct().alias("b"), ended("o", "b"), "left_semi")
    alike_here = both.select(*ENDS, *runs_in("here", "a")).select(*ENDS, (F.col("base") + F.col("h.start")).alias("start"), (F.col("base") + F.col("h.end")).alias("end"))
    unlike = o.join(alike_here.alias("v"), ended("o", "v") & (place >= F.col("v.start")) & (place < F.col("v.end")), "left_anti").select("key").distinct()
    unlike = keep(unlike)
    entries = keep(pairs.join(unlike, "key", "left_semi").select(*ENDS, place.cast("int").alias("place"), "key"))
    masks = both.select(*ENDS, "a", F.explode("common").alias("m"))
    masks = keep(masks.select(*ENDS, F.struct((F.col("a") + F.col("m.start")).alias("start"), (F.col("a") + F.col("m.end")).alias("end")).alias("m")))
    discard(first, pairs, stretches, asked, held, both, unlike, alike, *([looked, each] if whole else []))
    return out, entries, masks


def each_window(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, key, at, h) of rows (doc_id, mark, key, lo, words): a row for each of the hashes packed in words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = [np.frombuffer(w, np.int64) for w in batch["words"]]
            n = np.fromiter(map(len, h), np.int64, len(h))
            row = np.repeat(np.arange(len(h)), n)
            at = batch["lo"].to_numpy(np.int64)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            out = batch[["doc_id", "mark", "key"]].iloc[row].reset_index(drop=True)
            yield out.astype({"doc_id": "Int64"}).assign(at=at, h=np.concatenate(h) if h else np.empty(0, np.int64))

    return rows.mapInPandas(run, "doc_id long, mark int, key long, at long, h long")


def joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component), a written table: the classes before, with those that the links (a, b) join made one. Others stand alone."""
    if classes is None:
        return keep(components(links))
    for end in "ab":
        links = links.join(classes.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    links = keep(links.filter("a <> b").distinct())
    if links.isEmpty():
        discard(links)
        return classes
    new = components(links).withColumnRenamed("component", "root").withColumnRenamed("node", "component")
    new = keep(new)
    after = classes.join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    after = keep(after.unionByName(new.select(F.col("component").alias("node"), F.col("root").alias("component"))).distinct())
    discard(links, new, classes)
    return after


def links_of(found: DataFrame) -> DataFrame:
    return found.select(whose().alias("a"), whose("first_id", "first_mark").alias("b"))


def surroundings(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(key, words, doc_id, mark, lo, class), a written table: the different surroundings of each key (word hashes, from the word ``lo``)
    and the first holder of each. named: (doc_id, mark, place, key, class).

    Holders of one surrounding are alike verbatim, so of one class.
    """
    asked = named.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("place", "key", "class")).alias("asked"))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for text, asks in zip(texts, asked, strict=True):
            slim = word_hashes(text).astype(np.uint32)
            out.append([slim[max(0, r["place"] - AROUND) : r["place"] + GRAM + AROUND].tobytes() for r in asks])
        return pd.Series(out, dtype=object)

    held = docs.alias("d").join(asked.alias("q"), same("d", "q")).select("d.doc_id", "d.mark", "q.asked", cut("d.text", "q.asked").alias("words"))
    held = held.select("doc_id", "mark", F.explode(F.arrays_zip("asked", "words")).alias("w")).select("doc_id", "mark", "w.asked.*", "w.words")
    first = F.min(F.struct("doc_id", "mark", F.greatest(F.col("place") - AROUND, F.lit(0)).alias("lo"), "class")).alias("f")
    return keep(held.groupBy("key", "words").agg(first).select("key", "words", "f.*"))


def promising(words: list[np.ndarray], classes: list[int], blocks: list[int]) -> np.ndarray:
    """Places of the surroundings that may be alike to one of another class (and block, where there are two), in order.

    Shingles that one class alone has take no part in such a pair, so windows without enough others fall away, and then, once more,
    shingles that only one class has in the windows left: similar_spans looks twice too. What is left must make up MIN_WORDS words.
    Time grows with the words, not with pairs.
    """
    n, gap = len(words), 2 * SHINGLE + 2  # empty places between two texts, over which no run of words reaches
    sizes = np.fromiter(map(len, words), np.int64, n)
    begin = np.cumsum(sizes + gap) - sizes - gap
    row = np.repeat(np.arange(n, dtype=np.int32), sizes + gap)
    flat = np.zeros(len(row), np.uint64)
    flat[np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)] = np.concatenate(words)
    left = np.maximum(sizes - SHINGLE + 1, 0)[row] - (np.arange(len(row)) - begin[row])  # shingles from here to the text's end
    at = np.flatnonzero(left > 0)
    if not len(at):
        return at
    different, number = np.unique(shingles(np.append(flat, np.zeros(SHINGLE - 1, np.uint64)))[at], return_inverse=True)
    kinds = [np.unique(x, return_inverse=True)[1] for x in (classes, blocks)]
    mark, fits = np.ones(len(at), bool), left >= LEAST
    del flat, left
    for _ in range(2):
        several, seen = np.ones(len(different), bool), number[mark]
        for kind in kinds if kinds[1].any() else kinds[:1]:
            low, high, own = np.full(len(different), n), np.full(len(different), -1), kind[row[at[mark]]]
            np.minimum.at(low, seen, own)
            np.maximum.at(high, seen, own)
            several &= low < high
        mark &= several[number]
        total = np.zeros(len(row) + LEAST, np.int64)
        total[at + 1] = mark
        total = np.cumsum(total)
        good = np.flatnonzero(fits & (total[LEAST:] - total[:-LEAST] >= SHARED))
        edge = np.zeros(len(row) + LEAST, np.int64)
        edge[good] += 1
        edge[good + LEAST] -= 1
        mark &= np.cumsum(edge)[at] > 0
    total = np.zeros(len(row) + 1, np.int64)
    total[at + 1] = mark
    total = np.cumsum(total)
    near = total[1:] > total[np.maximum(np.arange(len(row)) - 2 * SHINGLE, 0)]
    steps = np.concatenate([[0], np.cumsum(near)])
    return np.unique(row[np.flatnonzero(steps[CHAIN:] - steps[:-CHAIN] == CHAIN)])


def sums(marks: np.ndarray, before: int, after: int) -> np.ndarray:
    """Running sums along each row, from 0 on, with so many places without marks before and after it."""
    width = marks.shape[1]
    total = np.zeros((len(marks), before + 1 + width + after), np.int16)
    np.cumsum(marks, axis=1, dtype=np.int16, out=total[:, before + 1 : before + 1 + width])
    total[:, before + 1 + width :] = total[:, before + width, None]
    return total


def in_windows(held: np.ndarray) -> np.ndarray:
    """Those of the marked shingles (a row each text) that lie in windows with enough of them."""
    total, width = sums(held, 0, LEAST), held.shape[1]
    total = sums(total[:, LEAST : LEAST + width] - total[:, :width] >= SHARED, LEAST - 1, 0)
    return held & (total[:, LEAST:] > total[:, :-LEAST])


def make_up_passages(mark: np.ndarray) -> np.ndarray:
    """Whether a row's marked shingles may make up MIN_WORDS words, single changed ones among them."""
    total = sums(mark, 2 * SHINGLE, 2 * SHINGLE)
    steps = sums(total[:, 2 * SHINGLE + 1 :] > total[:, : -2 * SHINGLE - 1], 0, 0)
    return (steps[:, CHAIN:] - steps[:, :-CHAIN]).max(1, initial=0) == CHAIN


def near_enough(one: np.ndarray, others: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Which of the others (numbers of shingles, a row each) may be alike to one: the steps of similar_spans for all of them at once.

    A window of one that another has enough of has one of its RARE rarest shingles in common with it, so only others with such a
    shingle are looked at. ``local`` has a place for each number and is all -1, before and after.
    """
    if len(one) < LEAST:
        return np.empty(0, np.int64)
    different, place = np.unique(one, return_inverse=True)
    local[different] = np.arange(len(different))
    at = local[others]
    local[different] = -1
    often = np.bincount(at.ravel() + 1, minlength=len(different) + 1)[1:]
    rare = np.argpartition(np.lib.stride_tricks.sliding_window_view(often[place], LEAST), RARE - 1, axis=1)[:, :RARE]
    chosen = np.zeros(len(different) + 1, bool)
    chosen[place[rare + np.arange(len(rare))[:, None]]] = True
    chosen[-1] = False
    rows = np.flatnonzero(chosen[at].any(1))
    rows = rows[(at[rows] >= 0).sum(1) >= SHARED]
    at = at[rows]
    there = in_windows(at >= 0)
    good = np.flatnonzero(make_up_passages(there))
    rows, at, there = rows[good], at[good], there[good]

    def held(i: np.ndarray, number: np.ndarray) -> np.ndarray:
        marks = np.zeros((len(rows), len(different) + 1), bool)  # the last column, for -1, has none
        marks[i, number] = True
        return marks

    def ours(marks: np.ndarray) -> np.ndarray:
        i, j = np.nonzero(marks)
        return in_windows(held(i, at[i, j])[:, place])

    good = np.flatnonzero(make_up_passages(ours(there)))
    rows, at = rows[good], at[good]
    i, j = np.nonzero(ours(at >= 0))
    return rows[make_up_passages(in_windows(np.take_along_axis(held(i, place[j]), at, 1)))]


def alike_pairs(words: list[np.ndarray], classes: list[int], blocks: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(later, earlier, runs of the later one) of some surroundings, in order: each with the first that is alike and of another class, and
    with others as far as that joins classes that are not joined yet. Where there are two blocks, only those of unlike blocks meet.

    Only those of unlike classes are compared, and of them only the ``promising``, each of the smaller class with all of larger ones at once.
    """
    place = promising(words, classes, blocks)
    if len(place) < 2:
        return
    words = [words[k] for k in place.tolist()]
    g = [shingles(w) for w in words]
    sizes = np.fromiter(map(len, g), np.int64, len(g))
    _, number = np.unique(np.concatenate(g), return_inverse=True)
    table = np.full((len(g), int(sizes.max())), int(number.max()) + 1, np.int32)  # past a text's end: what none has
    table[np.arange(table.shape[1])[None, :] < sizes[:, None]] = number
    _, root, n = np.unique(np.array(classes, np.int64)[place], return_inverse=True, return_counts=True)
    rank, side = np.argsort(np.argsort(n, kind="stable"))[root], np.array(blocks, np.int64)[place]
    local, alike, two = np.full(int(table.max()) + 1, -1, np.int32), np.zeros((len(g), len(g)), bool), len(set(blocks)) > 1
    for k in range(len(g)):
        rest = np.flatnonzero((rank > rank[k]) & (side != side[k]) if two else rank > rank[k])
        if len(rest):
            o = rest[near_enough(table[k, : sizes[k]], table[rest], local)]
            alike[np.maximum(k, o), np.minimum(k, o)] = True
    for k in np.flatnonzero(alike.any(1)).tolist():
        rest, met = np.flatnonzero(alike[k]), False
        while len(rest):
            o, rest = int(rest[0]), rest[1:]
            here, there, _ = similar_spans(words[k], words[o])
            if len(here) and len(there):
                yield int(place[k]), int(place[o]), here
                if root[k] != root[o]:
                    root[root == root[k]] = root[o]
                met = True
            if met:
                rest = rest[root[rest] != root[k]]


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The surroundings (key, words, class ...), a row for each two blocks (``pair``) of its key that meet, and on which side (``block``) it stands.

    sizes: (key, class, n). A class of over TOGETHER has blocks of its own, which do not meet each other; the small classes of a
    key share blocks, which meet all. So a class of copies is not copied more often than the others have blocks.
    """
    sizes = sizes.withColumn("alone", F.col("n") > TOGETHER).withColumn("owner", F.when(F.col("alone"), F.col("class")).otherwise(F.lit(0)))
    parts = keep(sizes.groupBy("key", "alone", "owner").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts")))
    of_class = sizes.select("key", "class", "alone", "owner").join(parts, ["key", "alone", "owner"])
    each = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    x, y = (each.select("key", F.struct("alone", "owner", "part").alias(c)) for c in "xy")
    unlike = (F.col("x.owner") != F.col("y.owner")) | (F.col("x.alone") != F.col("y.alone")) | ~F.col("x.alone")
    pairs = keep(x.join(y, "key").filter((F.col("x") <= F.col("y")) & unlike).withColumn("pair", F.xxhash64("x", "y")))
    meets = pairs.select("key", "x.*", "pair", F.lit(0).alias("block")).unionByName(pairs.filter("x <> y").select("key", "y.*", "pair", F.lit(1).alias("block")))
    rows = rows.join(of_class, ["key", "class"]).withColumn("part", F.expr("cast(pmod(xxhash64(words), parts) AS int)"))
    return rows.join(meets, ["key", "alone", "owner", "part"])


def resolved(rows: DataFrame) -> DataFrame:
    """(ENDS, start, end) from surroundings of keys, ``dealt`` out."""
    # by number, so that few bytes with much to compare are not put into a few tasks
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "doc_id", "mark", "lo")  # null ids first

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def compare(group: pd.DataFrame) -> Iterator[tuple]:
            ids, marks, base = ([None if pd.isna(i) else int(i) for i in group[c]] for c in ("doc_id", "mark", "lo"))
            words = [np.frombuffer(w, np.uint32).astype(np.uint64) for w in group["words"]]
            for k, o, here in alike_pairs(words, group["class"].tolist(), group["block"].tolist()):
                for s, e in here.tolist():
                    yield ids[k], marks[k], ids[o], marks[o], base[k] + s, base[k] + e

        def table(groups: list[pd.DataFrame]) -> pd.DataFrame:
            found = [x for group in groups for x in compare(group)]
            return pd.DataFrame({c: pd.array([x[k] for x in found], kind) for k, (c, kind) in enumerate(zip((*ENDS, "start", "end"), ("Int64", "Int32") * 2 + ("Int32",) * 2, strict=True))})

        rest = None  # the last group of a batch may go on in the next
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key, pair = batch["key"].to_numpy(np.int64), batch["pair"].to_numpy(np.int64)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist()]
            yield table([batch.iloc[s:e] for s, e in zip(edge, edge[1:], strict=False)])
            rest = batch.iloc[edge[-1] :]
        if rest is not None:
            yield table([rest])

    return rows.select("key", "pair", "block", "doc_id", "mark", "lo", "class", "words").mapInPandas(run, "doc_id long, mark int, first_id long, first_mark int, start int, end int")


def going_on(
    docs: DataFrame, entries: DataFrame, masks: DataFrame, out: DataFrame, classes: DataFrame | None
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(passages, asks, classes) from keys with a holder that is unlike the one compared with, if all others are of several classes.

    passages: from keys with DEALT surroundings outside their largest class at the most, which end here. asks: (doc_id, mark, asks), see ``joined_keys``: all holders of other keys,
    with what goes on into the next round (None: there is none).
    """
    if entries.isEmpty():
        discard(classes)
        return None, None, None
    classes = joined(classes, links_of(out))
    named = entries.select("doc_id", "mark", "place", "key").distinct().withColumn("node", whose()).join(classes, "node", "left")
    named = keep(named.withColumn("class", F.coalesce("component", "node")).drop("node", "component"))
    several = keep(named.groupBy("key").agg((F.min("class") != F.max("class")).alias("several")).filter("several").select("key"))
    rows = surroundings(docs, named.join(several, "key", "left_semi"))
    sizes = keep(rows.groupBy("key", "class").agg(F.count("*").alias("n")))
    # what stands outside a key's largest class decides how often its surroundings are copied
    counts = keep(sizes.groupBy("key").agg((F.sum("n") - F.max("n")).alias("rest")))
    few = counts.filter(f"rest <= {DEALT}").select("key")
    near = keep(resolved(dealt(rows.join(few, "key"), sizes.join(few, "key"))))
    discard(named, several, rows, sizes)
    many = counts.filter(f"rest > {DEALT}").select("key")
    if many.isEmpty():
        discard(counts, classes)
        return near, None, None
    classes = joined(classes, links_of(near))
    going = entries.join(many, "key", "left_semi").groupBy(*ENDS).agg(F.collect_set(F.struct("place", "key")).alias("held"))
    theirs = masks.groupBy(*ENDS).agg(F.collect_set("m").alias("masks"))
    going = going.alias("o").join(theirs.alias("m"), ended("o", "m"), "left").select("o.*", "m.masks")
    asks = keep(going.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("held", "masks")).alias("asks")))
    discard(counts)
    return near, asks, classes


def unite(batch: pd.Series) -> pd.Series:
    """Overlapping and touching runs become one."""
    return pd.Series([[{"start": s, "end": e} for s, e in merged([(r["start"], r["end"]) for r in runs])] for runs in batch], dtype=object)


def spans_of(found: DataFrame) -> DataFrame:
    """doc_id, mark, spans: the runs of words that an earlier document holds, for each document that has any."""
    return found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("r")).select("doc_id", "mark", F.pandas_udf(unite, "array<struct<start: int, end: int>>")("r").alias("spans"))


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_spans, n_repeated, n_links, first_id, class_id, repeated.

    n_repeated: words in passages of MIN_WORDS words or more that a document with a smaller id has too (in n_spans runs);
    n_links: verified pairs of passages that the row takes part in on this side; first_id: the smallest id among the
    documents that have one of its passages first (null: none); class_id: the smallest id reachable over shared passages,
    its own included; repeated: whether another document shares a passage with it. Null and short texts have none; texts of
    any length are read whole. Rows with one id are one document if their texts agree; a row without an id comes before all
    others and has no class. A passage twice in one document only is no repeat. An empty table gives none; further columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    found = repeats(docs)
    cuts = spans_of(found)
    links = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n_links"), F.min("first_id").alias("first_id"))
    cuts = cuts.join(links.withColumnRenamed("doc_id", "i").withColumnRenamed("mark", "m"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).drop("i", "m")
    classes = components(found.filter("doc_id is not null and first_id is not null").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((len(words(t)) for t in texts), np.int64, len(texts)))

    d = docs.select("doc_id", count("text").alias("n_words"), text_mark(F.col("text")).alias("mark"))
    c = cuts.select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "spans", "n_links", "first_id")
    out = d.join(c, d["doc_id"].eqNullSafe(c["i"]) & (d["mark"] == c["m"]), "left").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return out.select(
        "doc_id", "n_words", F.size(spans).cast("long").alias("n_spans"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("n_repeated"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first_id", F.coalesce("component", "doc_id").alias("class_id"),
        (F.col("component").isNotNull() | F.coalesce(F.col("n_links") > 0, F.lit(False))).alias("repeated"),
    )


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those runs of words; what stands between the other words stays as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _word.finditer(raw)] + [len(raw)]
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at : starts[s]])
        at = starts[min(e, len(starts) - 1)]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage left in the document that has it first and cut from all others.

    All columns stay, whatever their names; other documents' texts are not touched. A document of which nothing is left goes.
    Null, empty and short texts have no passages; rows of one id and text are one document and are cut alike; a passage that
    only one document has, even twice, stays. An empty table gives an empty one.
    """
    slim = plain(docs, id_col, text_col)
    cuts = keep(spans_of(repeats(slim)))

    @F.pandas_udf("string")
    def apply(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(t, [(r["start"], r["end"]) for r in s]) for t, s in zip(texts, spans, strict=True)])

    rows = docs.select(F.struct("*").alias("row"))
    text = F.col(f"d.row.`{text_col}`")
    ours = F.col(f"d.row.`{id_col}`").cast("long").eqNullSafe(F.col("c.doc_id")) & (text_mark(text) == F.col("c.mark"))
    after = rows.alias("d").join(cuts.alias("c"), ours, "left").select("d.row", F.when(F.col("c.spans").isNull(), text).otherwise(apply(text, F.col("c.spans"))).alias("new"), F.col("c.spans").isNull().alias("whole"))
    return after.filter(F.col("whole") | (F.trim("new") != "")).select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
