"""Staged publishing: tables are written aside, all audits look at what was written, and only then one manifest makes them visible.

A reader takes the tables that the newest manifest names, so a job that fails anywhere leaves no half bundle: what is
without a manifest is never read. A manifest holds each table's rows and a digest that does not depend on their order.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.tables import shared_folder
from orrery.plans.registry import query
from orrery.sources.views import table

MANIFEST = "bundle string, at long, name string, path string, n_rows long, digest long, columns string"
Audit = Callable[[dict[str, DataFrame]], DataFrame]


class Refused(Exception):
    """An audit found something: nothing was published. ``findings`` has what each audit found."""

    def __init__(self, findings: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {n}" for k, n in findings.items() if n))
        self.findings = findings


def row_digest(columns: list[str]) -> Column:
    """32 bits of the row's md5; nulls are told from empty texts."""
    fields = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *fields)), 1, 8), 16, 10).cast("long")


def facts(df: DataFrame) -> DataFrame:
    """One row: n_rows, and the digest, a sum over rows (modulo 2**62), so partial sums of any tasks add up."""
    total = F.sum(row_digest(df.columns).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.pmod(total, F.lit(1 << 62)), F.lit(0)).cast("long").alias("digest"))


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], audits: dict[str, Audit]) -> DataFrame:
    """Write ``tables`` as a new bundle in ``folder``, if no audit finds anything; its manifest's rows.

    Each audit is given the written tables by name and returns its findings, one row each; all audits are made before anything is
    decided. If one has findings, the written tables are deleted and Refused is raised; earlier bundles stay as they are. Tables
    may be empty, and may have columns of any names; without tables or audits the bundle is published as it is.
    """
    name, folder = uuid.uuid4().hex, folder.rstrip("/")
    aside = f"{folder}/tables/{name}"
    written = {}
    for k, df in tables.items():
        df.write.parquet(f"{aside}/{k}")
        written[k] = spark.read.schema(df.schema).parquet(f"{aside}/{k}")
    findings = {k: audit(written).count() for k, audit in audits.items()}
    if any(findings.values()):
        path = spark._jvm.org.apache.hadoop.fs.Path(aside)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        raise Refused(findings)
    at, rows = time.time_ns(), []
    for k, df in written.items():
        f = facts(df).first()
        rows.append((name, at, k, f"{aside}/{k}", f.n_rows, f.digest, ",".join(sorted(df.columns))))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")  # one file, last
    return newest(spark, folder).filter(F.col("bundle") == name)


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest manifest (a bundle's tables)."""
    every = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    return every.join(F.broadcast(every.agg(F.max_by("bundle", F.struct("at", "bundle")).alias("bundle"))), "bundle").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest bundle by name."""
    return {r.name: spark.read.parquet(r.path) for r in newest(spark, folder).collect()}  # a row for each table


def differences(spark: SparkSession, folder: str) -> DataFrame:
    """AU08: tables of the newest bundle whose rows or digest are no longer those of its manifest (name, n_rows, digest, found_rows, found_digest)."""
    manifest = newest(spark, folder)
    found = None
    for name, df in read(spark, folder).items():
        one = facts(df).select(F.lit(name).alias("name"), F.col("n_rows").alias("found_rows"), F.col("digest").alias("found_digest"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return manifest.select("name", "n_rows", "digest", F.col("n_rows").alias("found_rows"), F.col("digest").alias("found_digest"))
    both = manifest.join(found, "name").select("name", "n_rows", "digest", "found_rows", "found_digest")
    return both.filter("n_rows <> found_rows OR digest <> found_digest")


_digest = "CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 8)) AS BIGINT)) AS BIGINT)"


def _fields(*columns: str) -> str:
    return ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns)


@query(
    f"""SELECT 'customers' AS name, count(*) AS n_rows, {_digest.format(_fields('c_custkey', 'c_nationkey'))} AS digest, 0 AS findings FROM customer
UNION ALL SELECT 'lines', count(*), {_digest.format(_fields('l_linestatus', 'l_orderkey', 'n'))}, 0 FROM (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)"""
)
def snk09_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK09, AU08: two tables published as one bundle after three audits; what its manifest says, and how many tables differ from it."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"))
    tables = {"customers": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "lines": lines}
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    audits = {
        "nation_unknown": lambda t: t["customers"].join(nations, "c_nationkey", "left_anti"),
        "key_repeated": lambda t: t["customers"].groupBy("c_custkey").count().filter("count > 1"),
        "order_without_lines": lambda t: t["lines"].filter("n < 1"),
    }
    manifest = publish(spark, folder, tables, audits)
    wrong = differences(spark, folder).agg(F.count("*").cast("int").alias("findings"))  # one row
    return manifest.select("name", "n_rows", "digest").crossJoin(F.broadcast(wrong))
