import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from cases import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from orrery.llm.bpe import ByteBpe, Codec, bpe_digest
from orrery.llm.token_counts import read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def truth():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(None, PATH), public_tokenizers.PATTERN)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts_and_all_planes(codec, truth):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh éüñ 12 \t\n!?'sß漢字💥​\u0085\x1c") for _ in range(80)) for _ in range(800)]
    texts += ["".join(f"a{chr(c)} {chr(c)}1" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 64)]
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        assert ids(packed) == truth.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_offsets_and_split_characters(spark, truth):
    df = spark.createDataFrame([(1, "né 漢字💥 done"), (2, None)], "doc_id long, text string")
    bpe = ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    rows = df.select(bpe.encode(F.col("text"), offsets=True).alias("e")).select("e.*", bpe.decode(F.col("e.ids")).alias("back")).collect()
    assert bytes(rows[0].back).decode() == "né 漢字💥 done" and rows[1].ids == [] and bytes(rows[1].back) == b""
    assert rows[0].starts[0] == 0 and rows[0].ends[-1] == len("né 漢字💥 done")
    whole = "né 漢字💥 done"
    for i, a, b in zip(rows[0].ids, rows[0].starts, rows[0].ends, strict=True):
        assert truth.decode_single_token_bytes(i) in whole[a:b].encode()


def test_digest(spark, truth):
    got = sorted(map(tuple, bpe_digest(awkward(spark), PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text, *_ in AWKWARD:
        e = truth.encode_ordinary(text or "")
        want.append((i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_digest(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
