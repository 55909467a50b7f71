"""Operator 7, byte-level BPE: encoding by public rank files with the tokenizers library over Arrow batches, and back.

Text is cut by the pattern that comes with the rank file; every different cut is encoded once per worker by the
library's BPE model over byte-to-character mapped symbols and remembered (in bounded memory). Decoding reverses the byte table, so a
character split over several tokens comes back from their joined bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from orrery.llm.common import small_batches
from orrery.llm.token_counts import read_ranks

#: Cuts that a worker remembers at most, the longest cut that is remembered, and characters looked at together.
MEMO_ENTRIES, MEMO_CHARS, CHUNK_CHARS = 150_000, 64, 1 << 19
#: White_Space of Unicode, as Rust's pattern library has it; Python's own class holds four controls more.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def explicit(pattern: str) -> str:
    """The pattern with its blank classes spelled out, so that both pattern libraries agree on them."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.character = byte_characters()
        name = {piece: "".join(self.character[b] for b in piece) for piece in ranks}
        merges = [
            (name[a], name[b])
            for piece, rank in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(piece))
            if ranks.get(a := piece[:i], rank) < rank and ranks.get(b := piece[i:], rank) < rank
        ]
        self.model = Tokenizer(models.BPE(vocab={name[p]: r for p, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.cut = regex.compile(explicit(pattern))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.table = {b: c for b, c in enumerate(self.character)}
        self.memo: dict[str, bytes] = {}

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        mapped = [c.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for c in cuts]
        found = self.model.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(cuts)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        cuts = [self.cut.findall(t) for t in texts]
        new = list({c for found in cuts for c in found}.difference(memo))
        got = dict(zip(new, self.encode_cuts(new), strict=True)) if new else {}
        if len(memo) + len(got) <= MEMO_ENTRIES:
            memo.update((c, ids) for c, ids in got.items() if len(c) <= MEMO_CHARS)
        return [b"".join([memo[c] if c in memo else got[c] for c in found]) for found in cuts]

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens that share a split character overlap in it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return (character[starts], character[ends - 1] + 1) if len(ends) else (ends, ends)


def chunks(texts: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    yield held


class ByteBpe:
    """Columns of encodings by one rank file. Null texts are encoded as empty ones (no tokens)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        small_batches(spark)
        self.shared = spark.sparkContext.broadcast((read_ranks(spark, path), pattern))

    def encode(self, text: Column, offsets: bool = False) -> Column:
        """struct(ids array<int>[, starts, ends array<int>]): whole texts, without special tokens."""
        shared, kind = self.shared, "ids array<int>" + ", starts array<int>, ends array<int>" * offsets

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = Codec(*shared.value)
            for texts in batches:
                rows = []
                for part in chunks(texts):
                    for t, ids in zip(part, codec.encode(part), strict=True):
                        rows.append((np.frombuffer(ids, "<u4").astype(np.int32), *(codec.offsets(t, ids) if offsets else ())))
                yield pd.DataFrame(rows, columns=["ids", "starts", "ends"][: 3 if offsets else 1])

        return run(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the tokens stand for, joined (whole characters again, wherever the tokens split them)."""
        shared = self.shared

        @F.pandas_udf("binary")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = Codec(*shared.value)
            for batch in batches:
                yield pd.Series([codec.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch], dtype=object)

        return run(ids)

    def digest(self, text: Column) -> Column:
        """struct(n_tokens, ids_sha256, decoded_sha256) of the encoding and of the text decoded from it."""
        shared = self.shared

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = Codec(*shared.value)
            for texts in batches:
                rows = []
                for part in chunks(texts):
                    for ids in codec.encode(part):
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return run(text)


def bpe_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty: no tokens, digests of nothing. Repeated rows and repeated or null ids give one row each;
    other columns are ignored. No shuffle.
    """
    digest = ByteBpe(docs.sparkSession, path, pattern).digest(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), digest.alias("d")).select("doc_id", "d.*")
