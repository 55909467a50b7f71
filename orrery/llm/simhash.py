"""Operator 5, SimHash near-duplicates: fingerprints linked within a few bits by the generalised pigeonhole principle.

Bits that vary together are put in one partition. Each fingerprint chooses, by dynamic programming on estimated
candidate counts, one threshold for each partition such that the thresholds plus one add up to the total plus one:
two fingerprints within the total then agree within the threshold of some partition. It probes those values, and what
meets at a value is verified on all 64 bits. Estimates steer the cost only; every link is found whatever they say.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import keep, plain, words
from orrery.llm.components import components

#: Fingerprints that the estimates look at, those compared in one group (larger groups are dealt out as pairs of blocks),
#: and the cost of a probe against that of a candidate.
SAMPLE, BLOCK, PROBE_COST = 1024, 4096, 2.0


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: bit i is 1 if it is set in over half of the XXH64 (seed 42) of the word shingles, repeats included."""
    w = words(text)
    if not w:
        return 0
    if len(w) < width:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    digest = xxhash.xxh64_intdigest
    ones, n, grams = np.zeros(64, np.int64), 0, zip(*(islice(w, i, None) for i in range(width)), strict=False)
    while part := [digest(b" ".join(g), 42) for g in islice(grams, 1 << 15)]:
        n += len(part)
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return run(text)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of like width; each grows by the bit most correlated with those it has."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    r = np.abs(bits.T @ bits) / norm[:, None] / norm
    left, groups = list(range(64)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        inner = r[np.ix_(left, left)].sum(1)
        group = [left.pop(int(inner.argmax()))]
        while len(group) < width:
            group.append(left.pop(int(r[np.ix_(left, group)].sum(1).argmax())))
        groups.append(sorted(group))
    return groups


def flips(group: list[int], errors: int) -> np.ndarray:
    """Masks of exactly ``errors`` bits of a partition."""
    return np.array([sum(1 << b for b in c) for c in combinations(group, errors)], np.uint64)


def allocate(fps: np.ndarray, sample: np.ndarray, groups: list[list[int]], total: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (-1: no probe) of each fingerprint for each partition, and the cost expected, by dynamic programming.

    The candidates at a threshold are estimated as ``rows`` times the share of the sample within it in that partition.
    """
    n, steps = len(fps), total + 2  # threshold -1 .. total
    best = np.full((n, total + 2), np.inf)
    best[:, 0] = 0
    chosen = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        cost = np.zeros((n, steps))
        for a in range(0, n, 4096):
            far = np.bitwise_count((fps[a : a + 4096, None] ^ sample[None, :]) & mask)
            for e in range(total + 1):
                cost[a : a + 4096, e + 1] = (far <= e).sum(1) * (rows / max(1, len(sample)))
        cost[:, 1:] += PROBE_COST * np.cumsum([len(flips(group, e)) for e in range(total + 1)])
        after, pick = np.full_like(best, np.inf), np.zeros((n, total + 2), np.int8)
        for have in range(total + 2):  # have: sum of (threshold + 1) so far
            for e in range(steps):
                if have + e <= total + 1:
                    c = best[:, have] + cost[:, e]
                    better = c < after[:, have + e]
                    after[better, have + e], pick[better, have + e] = c[better], e
        best = after
        chosen.append(pick)
    out, at = np.empty((n, len(groups)), np.int8), np.full(n, total + 1)
    for g in range(len(groups) - 1, -1, -1):
        e = chosen[g][np.arange(n), at]
        out[:, g], at = e - 1, at - e
    return out, best[:, total + 1]


def local_stars(fps: np.ndarray, total: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its component) for each that has a link within one group; no pair list is built."""
    free, edges = np.unique(fps), []
    while len(free) > 1:
        root, wave, free = free[0], free[:1], free[1:]
        while len(wave) and len(free):
            near = np.zeros(len(free), bool)
            for a in range(0, len(wave), 256):
                near |= (np.bitwise_count(wave[a : a + 256, None] ^ free[None, :]) <= total).any(0)
            wave, free = free[near], free[~near]
            edges += [(int(x), int(root)) for x in wave]
    return edges


def link(distinct: DataFrame, total: int = 3) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` of ``distinct`` (different longs) within ``total`` bits.

    Edges form stars within each group that met, so their number follows that of the fingerprints, never its square. A
    group over BLOCK is dealt out as pairs of blocks: every two of its members still meet, in bounded memory.
    """
    rows = distinct.count()
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plans = [group_bits(sample, m) for m in (2, 3, 4)]
    groups = min(plans, key=lambda g: allocate(sample, sample, g, total, rows)[1].mean() if len(sample) else 0)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 8192):
                fps = batch["fp"].to_numpy(np.int64)[a : a + 8192].view(np.uint64)
                thresholds, _ = allocate(fps, sample, groups, total, rows)
                for g, group in enumerate(groups):
                    mask = np.uint64(sum(1 << b for b in group))
                    at, own = [fps & mask], [fps]
                    for e in range(1, total + 1):
                        asks = fps[thresholds[:, g] >= e]
                        masks = flips(group, e)
                        at.append(((asks & mask)[:, None] ^ masks[None, :]).ravel())
                        own.append(np.repeat(asks, len(masks)))
                    yield pd.DataFrame({"part": np.int32(g), "value": np.concatenate(at).view(np.int64), "fp": np.concatenate(own).view(np.int64)})

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            out = []
            for fps in lists:
                stars = local_stars(np.asarray(fps, np.int64).view(np.uint64), total)
                ends = np.array(stars, np.uint64).reshape(-1, 2).view(np.int64).tolist()
                out.append([{"a": a, "b": b} for a, b in ends])
            yield pd.Series(out, dtype=object)

    met = keep(distinct.select("fp").mapInPandas(probes, "part int, value long, fp long"))
    large = met.groupBy("part", "value").count().filter(F.col("count") > BLOCK).withColumnRenamed("count", "size")
    met = met.join(large, ["part", "value"], "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), "blocks").cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.groupBy("part", "value", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    met = met.agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.explode(solve("fps")).alias("e")).select("e.a", "e.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, total: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable over links, itself included).

    Fingerprints within ``total`` bits are linked. Null and blank texts have fingerprint zero, linked like any other; a
    text of fewer words than ``width`` is one shingle. Repeated rows give a row each; a null id is never a component's
    id unless it has no other. Documents with one fingerprint count once from the start, so groups of copies cost nothing more.
    """
    return grouped(plain(docs, id_col, text_col), width, total).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, width: int = 3, total: int = 3) -> DataFrame:
    """near_duplicates with the columns of ``docs`` (but its text) and component, which tells groups apart that have no id."""
    marked = keep(docs.withColumn("fp", fingerprint_column(F.col("text"), width)).drop("text"))
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(link(distinct, total))
    rooted = distinct.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = keep(rooted.join(named, "component").select("fp", "component", "component_id"))
    return marked.join(of_fp, "fp")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
