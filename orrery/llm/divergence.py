"""Operator 11, source divergence audit: how far each source of a language stands from each other one, and in which terms.

Every source gives every kept term of its language a smoothed share, so a sum over all terms of all pairs of sources would
be dense. It is taken by inclusion and exclusion over supports (the terms that a source holds): terms of the one side
are priced from a histogram of its counts, those of the other side likewise, as if the partner had none of them; a join of
postings corrects the terms that both hold; all terms that neither holds cost the same constant. All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import discard, keep, small_batches

#: What stands between terms; documents of a language that a kept term is in at least; terms reported for a source; unit of shares.
BETWEEN, LEAST_DOCS, TOP, SCALE = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 3, 200, 1_000_000_000
#: Rows of (lang, source, term) that a task gathers before it hands them on.
GATHER = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"


def tally(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch of (lang, source, text): occurrences, and documents (rows) that have the term."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BETWEEN)
    pairs = pa.table({"at": pc.list_parent_indices(pieces), "term": pc.list_flatten(pieces)})
    pairs = pairs.filter(pc.not_equal(pairs["term"], ""))
    each = pairs.group_by(["at", "term"], use_threads=False).aggregate([([], "count_all")])
    rows = {k: batch[k].take(each["at"].combine_chunks()) for k in ("lang", "source")}
    return merged([pa.table({**rows, "term": each["term"], "n": each["count_all"], "docs": pa.repeat(pa.scalar(1, pa.int64()), len(each))})])


def merged(parts: list[pa.Table]) -> pa.Table:
    """Tables of counts with like (lang, source, term) added up."""
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Counts from each task, summed there as far as GATHER rows go; docs: (lang, source, text) without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            parts.append(tally(batch))
            if sum(map(len, parts)) > GATHER:
                parts = [merged(parts)]
                if len(parts[0]) > GATHER // 2:
                    yield from parts.pop().to_batches(max_chunksize=50_000)
        if parts:
            yield from merged(parts).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, COUNTS)


def share(n: Column | int, total: str, kinds: str = "kinds") -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kinds)), by decimals: counts of any size are exact. Null where there is no term."""
    wide = lambda c: c.cast("decimal(19,0)")
    part = wide((n if isinstance(n, Column) else F.lit(n)) + F.lit(1))
    whole = F.nullif(F.col(total) + F.col(kinds), F.lit(0).cast("long"))
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * part, wide(whole))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has every other source of the language (item) with the
    divergence from its shares, part ``term`` the terms (item) that the source uses more than its language, the ``top`` by divergence.

    A term is a run of letters (A-Z, a-z, all beyond ASCII; only A-Z are lower-cased). A language keeps the terms that at
    least ``least_docs`` of its rows hold. Null text, lang and source count as ''. A group without any term takes part in pairs
    (all its shares are those of a count of 0); a language that keeps no term has value 0 for all pairs and no term row. Ranks
    go by value (descending), then item in UTF-8 order. Repeated rows count as often as they stand there; texts of any length
    are read whole; an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    # one shuffle by (lang, term) serves both the sum for a source and the window over a language's sources
    counts = term_counts(slim).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    counts = counts.withColumns({
        "in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "opens": (F.min("source").over(term) == F.col("source")).cast("long")
    })
    kept = keep(counts.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "opens"))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    whole = kept.groupBy("lang").agg(F.sum("opens").alias("kinds"), F.sum("n").alias("lang_total"))
    groups = slim.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = keep(groups.na.fill(0, ["total", "held", "kinds", "lang_total"]).withColumn("p0", share(0, "total")))

    pairs = pair_values(kept, groups)
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    priced = kept.join(groups.select("lang", "source", "total", "kinds", "lang_total"), ["lang", "source"])
    priced = priced.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), "total").alias("p"), share(F.col("lang_n"), "lang_total").alias("q"))
    terms = priced.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = terms.filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two different sources of a language, from the terms that they hold.

    kept: (lang, source, term, n), one row for each term that a source holds. groups: (lang, source, total, held, kinds, p0),
    p0 the share of a term not held. Rows grow with the sources that hold a term, as the answer does; both ways of a pair are
    taken from one row, and sums start before the shuffle.
    """
    names = ["source", "total", "held", "p0"]
    side = lambda k: groups.select("lang", "kinds", *[F.col(c).alias(f"{c}_{k}") for c in names])
    both = side("a").join(side("b").drop("kinds"), "lang").filter("source_a <> source_b")
    held = F.col("kinds") - F.col("held_a") - F.col("held_b")
    neither = both.select("lang", "source_a", "source_b", F.coalesce(held * gap(F.col("p0_a"), F.col("p0_b")), F.lit(0)).alias("value"))

    # a source's terms, by how often it has them, against any other source that had none of them: this way and the other
    steps = keep(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    steps = steps.withColumnRenamed("source", "source_a").join(side("a"), ["lang", "source_a"]).withColumn("p", share(F.col("n"), "total_a"))
    steps = steps.join(side("b").select("lang", "source_b", "p0_b"), "lang").filter("source_a <> source_b").groupBy("lang", "source_a", "source_b")
    steps = steps.agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("p0_b"))).alias("to_b"), F.sum(F.col("terms") * gap(F.col("p0_b"), F.col("p"))).alias("from_b"))
    steps = keep(steps)

    # terms that both hold were priced twice, each time as if one side had none
    posting = kept.join(groups.select("lang", "source", "total", "kinds", "p0"), ["lang", "source"])
    posting = keep(posting.select("lang", "term", "source", "p0", share(F.col("n"), "total").alias("p")))
    one, two = (posting.select("lang", "term", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "p0", "p")]) for k in "ab")
    met = one.join(two, ["lang", "term"]).filter("source_a < source_b")
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b"))
    mend = lambda p, q, p0, q0: F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0))
    met = keep(met.groupBy("lang", "source_a", "source_b").agg(mend(p, q, p0, q0).alias("there"), mend(q, p, q0, p0).alias("back")))

    turned = lambda df, value: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col(value).alias("value"))
    straight = lambda df, value: df.select("lang", "source_a", "source_b", F.col(value).alias("value"))
    parts = neither.unionByName(straight(steps, "to_b")).unionByName(turned(steps, "from_b")).unionByName(straight(met, "there")).unionByName(turned(met, "back"))
    found = keep(parts.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")))
    discard(steps, met, posting)
    return found.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value")
