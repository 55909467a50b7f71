"""Operator 1, token counts: greedy longest-match word pieces, counted in linear time without building pieces.

The vocabulary becomes a trie with failure links. Each node knows how many pieces are popped when its failure link is
followed, so one walk over a word's bytes yields the number of pieces; no byte is read twice.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import small_batches

#: A vocabulary file is broadcast; one larger than this is refused, so that what is broadcast has a fixed bound.
MAX_VOCABULARY_BYTES = 64 << 20


class Automaton(NamedTuple):
    """step: node * 256 + byte -> node; fail: node reached when no byte fits (-1: none); pops: pieces emitted then."""

    step: dict[int, int]
    fail: list[int]
    pops: list[int]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file (base64 piece, blank, rank on each line), read by the driver."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary over {MAX_VOCABULARY_BYTES} bytes: {path}")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def build(vocabulary: Iterable[bytes]) -> Automaton:
    step: dict[int, int] = {}
    ends = [False]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            key = node << 8 | byte
            if key not in step:
                step[key] = len(ends)
                ends.append(False)
            node = step[key]
        if piece:
            ends[node] = True
    fail, pops = [-1] * len(ends), [0] * len(ends)
    children: dict[int, list[tuple[int, int]]] = {}
    for key, child in step.items():
        children.setdefault(key >> 8, []).append((key & 255, child))
    queue = deque([0])
    while queue:
        parent = queue.popleft()
        for byte, node in children.get(parent, ()):
            queue.append(node)
            if ends[node]:
                fail[node], pops[node] = 0, 1
                continue
            back, popped = fail[parent], pops[parent]
            while back >= 0 and (back << 8 | byte) not in step:
                popped += pops[back]
                back = fail[back]
            if back >= 0:
                fail[node], pops[node] = step[back << 8 | byte], popped
    return Automaton(step, fail, pops)


def count_pieces(automaton: Automaton, word: bytes) -> int:
    """Pieces of one word; -1 if greedy longest match meets a rest that no piece begins."""
    step, fail, pops = automaton
    node = count = 0
    for byte in word:
        while (after := step.get(node << 8 | byte)) is None:
            if fail[node] < 0:
                return -1
            count += pops[node]
            node = fail[node]
        node = after
    while node:
        if fail[node] < 0:
            return -1
        count += pops[node]
        node = fail[node]
    return count


def token_counts(docs: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" ") -> DataFrame:
    """One row per document: doc_id, n_words, n_pieces, n_unknown.

    Words are the maximal runs without ASCII blanks; each is matched as ``prefix`` + its UTF-8 bytes, so pieces that
    begin with the prefix open a word and the others continue it. A word that cannot be matched counts as one unknown
    piece. Null and empty texts have zero words. Repeated rows and repeated or null ids give one row each; other columns
    are ignored. No shuffle: a batch keeps one count for each of its different words.
    """
    small_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(build(vocabulary))

    @F.pandas_udf("n_words long, n_pieces long, n_unknown long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = machine.value
        for texts in batches:
            known: dict[bytes, int] = {}
            rows = []
            for text in texts:
                found = text.encode("utf-8", "surrogatepass").split() if text else []
                for word in set(found).difference(known):
                    known[word] = count_pieces(automaton, prefix + word)
                counts = [known[w] for w in found]
                unknown = counts.count(-1)
                rows.append((len(found), sum(counts) + 2 * unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_pieces", "n_unknown"])

    found = docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("c"))
    return found.select("doc_id", "c.n_words", "c.n_pieces", "c.n_unknown")
