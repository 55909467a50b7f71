"""Operator 13, secret scans by an incremental ledger of blobs: DataFrame functions only, no Python on the executors.

A text is a blob, named by its SHA-256. The ledger (two Parquet tables in one folder) says which (blob, rule, version) was
looked at and what was found there. A scan of a history reads the texts of blobs with a rule or version that the
ledger lacks, one holder for each blob, looks for those rules only, and joins what the ledger then has back to all paths.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orrery.llm.common import discard, keep, shared_folder


class Rule(NamedTuple):
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` code points or more; a changed rule takes a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules first. What is too short is dropped after matching where what follows a failure matters, else by the pattern.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", 1, "(?:gh[opsu]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,})"),
)
#: Blobs to scan that are broadcast (48 bytes of data each); of more, texts are shuffled by id and blob.
BROADCAST = 500_000
SCANNED, FINDINGS = "blob binary, kind string, version int", "blob binary, kind string, version int, start long, end long"


class Ledger:
    """The two tables in ``folder`` (shared by driver and executors), made when first used. Rows are only ever added.

    Findings are added before the pairs that say where they were looked for, so a job that fails between leaves pairs to scan
    again, never a pair without its findings; rows that a repeated scan adds twice are one when read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.folder}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(f"{self.folder}/findings").distinct()

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, start, end) of the matches in texts (blob, text, missing); bit i of missing asks for rule i.

    A text is split by the rule's own pattern: lengths of what lies between and of the matches, added up in order,
    are the places. Each match is a row, so a text with very many costs no more than they do. ``row`` only tells rows of one
    text apart.
    """
    text = F.col("text")

    def look(i: int, rule: Rule) -> Column:
        lengths = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))
        groups = [lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))) for g in (0, rule.group)]
        before = lengths(F.split(text, rule.pattern, -1))
        each = F.arrays_zip(F.slice(before, F.lit(1), F.size(groups[0])).alias("before"), groups[0].alias("size"), groups[1].alias("least"))
        here = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).cast("long").alias("needs"), each.alias("each"))
        return F.when((F.col("missing").bitwiseAND(1 << i) != 0) & text.rlike(rule.pattern), here)

    found = texts.select("blob", F.monotonically_increasing_id().alias("row"), F.explode(F.array_compact(F.array(*[look(i, r) for i, r in enumerate(rules)]))).alias("f"))
    found = found.select("blob", "row", "f.kind", "f.version", "f.needs", F.posexplode("f.each").alias("at", "m"))
    so_far = W.partitionBy("blob", "row", "kind").orderBy("at")
    found = found.withColumn("end", F.sum(F.col("m.before") + F.col("m.size")).over(so_far))
    return found.filter("m.least >= needs").select("blob", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")


def unscanned(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, holder, missing) of blobs that lack a rule in the ledger: the path that has the blob first, and the rules as bits."""
    bit = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bit = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(1 << i).cast("long")).otherwise(bit)
    holders = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id"))["doc_id"].alias("holder"))
    seen = ledger.scanned().groupBy("blob").agg(F.bit_or(bit).alias("seen"))
    missing = F.lit((1 << len(rules)) - 1).cast("long").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
    return holders.join(seen, "blob", "left").select("blob", "holder", missing.alias("missing")).filter("missing <> 0")


def scan_history(history: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``history``: doc_id, n_assign, n_access, n_hex, base_sha256, spans; the ledger grows by what was scanned.

    Each row is one version of the path ``id_col``; the same path may stand there with several texts. spans: kind:start:end
    of all rules (code points, end exclusive) by start, then in the order of ``rules``, comma-joined; base_sha256: the digest of
    those of the BASE rules alone; n_*: their counts. A null text is the empty one, without spans; a null id is a path like any other;
    texts of any length are scanned whole; repeated rows give a row each; rules of one place each give their own span; an
    empty table gives none; further columns, whatever their names, are ignored. 62 rules at most, kinds without ``:`` and ``,``.
    """
    if len(rules) > 62 or len({r.kind for r in rules}) < len(rules):
        raise ValueError("62 rules at most, each of a kind of its own")
    docs = history.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
    paths = keep(docs.select("doc_id", "blob"))
    todo = keep(unscanned(paths, ledger, rules))
    few = F.broadcast(todo) if todo.count() <= BROADCAST else todo
    ours = few.withColumnRenamed("blob", "b")
    texts = docs.join(ours, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("holder"))).select("blob", "text", "missing")
    found = matches(texts, rules)
    one = F.array(*[F.when(F.col("missing").bitwiseAND(1 << i) != 0, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for i, r in enumerate(rules)])
    ledger.add(found, todo.select("blob", F.explode(F.array_compact(one)).alias("r")).select("blob", "r.*"))
    discard(todo)
    return report(paths, ledger, rules)


def report(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger has of the current versions of ``rules``, for each row of paths (doc_id, blob)."""
    place = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        place = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)).otherwise(place)
    found = ledger.findings().withColumn("place", place).filter("place is not null").join(paths.select("blob").distinct(), "blob", "left_semi")
    base = [r.kind for r in BASE]
    span = F.struct("start", "place", F.col("kind").isin(base).alias("base"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("s"), *counts)  # the spans of one text
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: s["span"]), ",")
    found = found.select("blob", *[f"n_{k}" for k in base], joined(F.col("s")).alias("spans"), joined(F.filter("s", lambda s: s["base"])).alias("base"))
    out = paths.join(found, "blob", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def new_ledger(spark: SparkSession) -> Ledger:
    """A ledger of its own in the shared folder, with nothing scanned."""
    return Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
