"""What the operators of this folder share: words, folds, and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.tables import discard, keep, shared_folder  # noqa: F401


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, with A-Z (only) in lower case; null has none.

    ``bytes.split()`` parts at exactly those six ASCII characters and ``bytes.lower()`` changes ASCII letters only.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of bounded size, unless the session has set its own."""
    for name, ours, usual in (("maxRecordsPerBatch", "1000", "10000"), ("maxBytesPerBatch", "8m", "67108864b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): further columns, whatever their names, stay out of an operator's way."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
