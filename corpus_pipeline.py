"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

toxicity: documents predicted toxic go. near_duplicates: of each group linked by SimHash one document stays. passages:
repeated passages stay in the first document that has them. decontamination: documents that hold a window of the
benchmark go. tokens: the rest is encoded by byte-level BPE, decoded and digested.

In all stages null and empty texts are texts without words; texts of any length are read whole; an empty table gives an
empty one; columns keep their order and may have any names beside doc_id and text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import toxicity as weak
from orrery.llm.bpe import bpe_digest
from orrery.llm.common import keep, plain, shared_folder, small_batches
from orrery.llm.passages import cut_repeats
from orrery.llm.queries import RANKS, table
from orrery.llm.simhash import grouped
from orrery.llm.suffixes import with_contamination


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5 stay; rows alike in text fare alike, whatever their ids, null and repeated ones too."""
    model = weak.train(plain(docs), table(spark, sf_dir, "labels"))
    return docs.filter(weak.score_column(docs, model, F.col("text")) < 0.5)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that with the smallest id (none counts as the largest), and of those with that id
    the one whose fields hash lowest. Rows alike in all fields count as one. Texts without words are all alike.

    Rows are told apart by id and fields together, so unlike documents with one id, or without any, do not fall together.
    """
    fields = F.struct("*")
    rows = docs.select(fields.alias("row"), F.xxhash64(F.to_json(fields)).alias("mark"))
    small_batches(spark)
    found = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.to_json(fields)).alias("mark")))
    found = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "mark", "n")).alias("f")
    first = keep(found.groupBy("component").agg(least).select("component", "f.*"))
    repeated = first.filter("n > 1")
    others = found.alias("o").join(first.alias("f"), "component").filter(~(F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o.mark") == F.col("f.mark"))))
    gone = keep(others.select("o.doc_id", "o.mark").unionByName(repeated.select("doc_id", "mark")))

    def meet(ids: DataFrame, how: str) -> DataFrame:
        return rows.alias("r").join(ids.alias("i"), F.col("r.row.doc_id").cast("long").eqNullSafe(F.col("i.doc_id")) & (F.col("r.mark") == F.col("i.mark")), how)

    stay = meet(gone, "left_anti").select("row").unionByName(meet(repeated, "left_semi").select("row").dropDuplicates())
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document (smaller id; none comes first) has are cut; a row left empty by that goes."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay that hold no window of any benchmark item; an empty benchmark leaves all."""
    found = with_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.filter("found.n_hit = 0").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each: doc_id, n_tokens and digests of ids and decoded bytes (null: those of the empty text)."""
    return bpe_digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates_stage),
    ("passages", passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot express the learned and the hashed stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
