"""A bounded sample of labelled documents, for operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold, keep

#: Labelled documents that a classifier is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Labels are learned from ids whose crc32 (as text) modulo this is not 0; the others are held out.
FOLDS = 5


def lowest(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``ids`` (doc_id, ...; different ids) whose ids hash lowest; what is surely beyond them is left out before the sort."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, 2.0 * n / max(1, ids.count()))
    return ids.filter(place < int(share * (1 << 40)) if share < 1 else F.lit(True)).orderBy(place, "doc_id").limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, label 0/1) of at most SAMPLE labelled ids that are not held out, one row each, as a written table.

    Labels other than 0 and 1, and null ids, are left out; of several labels for an id the largest holds, of several
    texts the smallest (a null one counts as empty).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(fold(F.col("doc_id"), FOLDS) != 0)
    known = lowest(keep(known.groupBy("doc_id").agg(F.max("label").alias("label"))), SAMPLE)
    return texts_of(docs, known).select("text", "label")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (SAMPLE rows at most, 240 kB) with a text each."""
    found = docs.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns)
    return keep(found.agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
