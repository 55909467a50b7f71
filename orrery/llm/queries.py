"""The queries of this folder by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe import bpe_digest
from orrery.llm.class_lm import lm_scores
from orrery.llm.divergence import divergence
from orrery.llm.licences import NOTICES, bigrams, licence_scan
from orrery.llm.passages import passage_report
from orrery.llm.quality import quality
from orrery.llm.secret_scan import RULES, new_ledger, scan_history
from orrery.llm.simhash import hexadecimal, near_duplicates
from orrery.llm.suffixes import contamination
from orrery.llm.token_counts import read_ranks, token_counts
from orrery.llm.toxicity import toxicity
from orrery.llm.variants import spelling_variants
from orrery.llm.voronoi import top_k

#: Vocabulary of operator 1, and rank file of operator 7.
PIECES, RANKS = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_ranks(spark, public_tokenizers.path(PIECES)))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_history(table(spark, sf_dir, "documents"), new_ledger(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_class_lm, op3_toxicity, op4_passages, op5_simhash, op6_decontamination, op7_byte_bpe,
        op8_top_k, op9_licences, op10_quality, op11_divergence, op12_variants, op13_secrets,
    )
}

_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_op6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower}, '{_letters}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower}, '{_letters}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS x
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, p, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.x = iw.x),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

_op8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS "rank", vec_id, score FROM r WHERE k <= 5
"""


def _op9(threshold: float = 0.8) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(n)}, [{', '.join(quote(x) for x in bigrams(t))}])" for i, (n, t) in enumerate(NOTICES))
    return rf"""
WITH notice(k, name, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
u AS (SELECT r, doc_id, CASE WHEN len(l) > 1 THEN list_append(l, text) ELSE l END AS units FROM d),
e AS (SELECT r, row_number() OVER () AS n, trim(regexp_replace({_lower.replace("text", "unit")}, '[^\pL\pN]+', ' ', 'g'), ' ') AS t FROM (SELECT r, unnest(units) AS unit FROM u)),
w AS (SELECT r, n, string_split(t, ' ') AS w FROM e),
g AS (SELECT r, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
every AS (SELECT r, n, name, 2.0 * len(list_intersect(g.b, notice.b)) / (len(g.b) + len(notice.b)) AS dice FROM g, notice WHERE len(g.b) <= 100),
m AS (SELECT r, n, arg_max(name, (dice, name)) AS name, max(dice) AS dice FROM every WHERE dice >= {threshold} GROUP BY r, n),
hit AS (SELECT r, count(*) AS n_matched, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, arg_max(name, (dice, name)) AS best_licence, max(dice) AS best
        FROM m GROUP BY r)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n_units, CAST(coalesce(n_matched, 0) AS BIGINT) AS n_matched, coalesce(licences, '') AS licences,
       best_licence, round(coalesce(best, 0.0), 6) AS best_dice
FROM u LEFT JOIN hit USING (r)
"""


_op11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_lower}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL HAVING sum(docs) >= 3),
k AS (SELECT o.lang, o.source, o.term, o.n FROM o JOIN l USING (lang, term)),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(v.total), 0) AS lang_total, coalesce(sum(k.n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN k USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, l.term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 1)) // (g.total + g.v) AS p,
             1 + (1000000000::HUGEINT * (l.n + 1)) // (g.lang_total + g.v) AS q FROM g JOIN l USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) t
         ON t.lang = a.lang AND t.source = a.source AND t.other = b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair
      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM u)
SELECT lang, source, part, item, value, "rank" FROM r WHERE part = 'pair' OR "rank" <= 200
"""


def _op13() -> str:
    """Spans by splitting at the patterns; letters in either case are written out, since DuckDB's own folding goes beyond ASCII."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() and c.isascii() else c for c in "password|passwd|secret|token|api_?key")
    patterns = {r.kind: (r.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", f"({either})").replace("'", "''"), r.group, r.least) for r in RULES}
    one = "\nUNION ALL ".join(
        f"SELECT r, {i} AS place, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda j: {{'j': j, 'start': CAST(list_sum(list_transform(b[:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m[: j - 1], lambda x: len(x))), 0) AS BIGINT), 'size': len(m[j]), 'least': len(t[j])}})) AS s, {least} AS needs"
        f" FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS t, string_split_regex(text, '{p}') AS b FROM d)"
        for i, (kind, (p, group, least)) in enumerate(patterns.items())
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({one}),
x AS (SELECT r, place, kind, s.start AS start, kind || ':' || s.start || ':' || (s.start + s.size) AS span FROM f WHERE s.least >= needs),
g AS (SELECT r, string_agg(span, ',' ORDER BY start, place) AS spans, string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SQL: dict[str, str] = {"op6_decontamination": _op6, "op8_top_k": _op8, "op9_licences": _op9(), "op11_divergence": _op11, "op13_secrets": _op13()}
