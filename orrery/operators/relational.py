"""Standard relational features over the driver's tables, and scalar functions of texts, times and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.sources.views import table


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c.k AS c_nation, s.k AS s_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k")
def full_outer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("c_nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("s_nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, F.col("c_nation") == F.col("s_nation"), "full_outer").select("c_nation", "s_nation", "customers", "suppliers")


@query("SELECT * FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def except_all_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).exceptAll(l.filter("l_returnflag = 'A'").select("l_suppkey"))


@query("SELECT o_custkey, o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def ranking_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS orders, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS value FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2")
def jn01_lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN01-JN03, JN20: equality joins along keys; the planner orders them and broadcasts what its statistics call small."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").filter("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("value"))


@query("SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn18_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18: only what is enrolled."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("custkey"))


@query("SELECT doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS size FROM (SELECT page_id AS doc_id, url, html FROM pages)")
def fn01_path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN01, SRC06, SRC20: keys out of a path."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("size"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), 'default') AS other FROM events")
def fn29_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24, FN29, SRC22: a JSON path with a default, read safely as a number."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "try_cast(get_json_object(props, '$.k') AS bigint) AS k", "coalesce(get_json_object(props, '$.absent'), 'default') AS other"
    )


@query("SELECT conv_id AS clip, count(*) AS frames, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id")
def ag13_distinct_and_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13: distinct counts and the ordered list of identities."""
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip")).agg(F.count("*").alias("frames"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), path.alias("path"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'small' WHEN n_chars < 2000 THEN 'medium' ELSE 'large' END AS tier, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS code, lang || '|' || source AS key, substr(md5(coalesce(source, '')), 1, 8) AS seed FROM documents")
def fn18_tiers_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN02-FN05, FN18, RND02: tiers, status codes, composite keys and seeds by identity."""
    tier = F.when(F.col("n_chars") < 200, "small").when(F.col("n_chars") < 2000, "medium").otherwise("large")
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return table(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), code.alias("code"), F.concat("lang", F.lit("|"), "source").alias("key"), F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 8).alias("seed"))


@query("SELECT doc_id, CAST(k * (n - 1) // 7 AS BIGINT) AS at, k FROM (SELECT doc_id, n_chars AS n, unnest(generate_series(0, 7)) AS k FROM documents WHERE n_chars > 0)")
def sl02_linspace_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL02: eight evenly spaced places, cut to whole numbers; repeated places stay."""
    d = table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", F.col("n_chars").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    return d.select("doc_id", F.expr("k * (n - 1) div 7 AS at"), "k")


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('sample|' || CAST(o_orderkey AS VARCHAR))) AS k FROM orders) SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM r WHERE k <= 2")
def sl03_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL03, RND01: two of each group in the order of a hash."""
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("sample|"), F.col("o_orderkey").cast("string")))))
    return table(spark, sf_dir, "orders").withColumn("k", k).filter("k <= 2").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


@query("WITH i AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey AS custkey, CAST(i % 3 AS INTEGER) AS strided, CAST(3 * i // n AS INTEGER) AS contiguous, i + 1 <= floor(n * 0.65) AS train FROM i")
def so06_bucket_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO06, SL07: strided and contiguous buckets, and a split at 65 percent, within each nation."""
    per = W.partitionBy("c_nationkey")
    i = table(spark, sf_dir, "customer").select("c_custkey", (F.row_number().over(per.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(per).alias("n"))
    return i.select(F.col("c_custkey").alias("custkey"), F.expr("i % 3 AS strided"), F.expr("cast(3 * i div n AS int) AS contiguous"), F.expr("i + 1 <= floor(n * 0.65D) AS train"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN07: events by day; the batch form of the streaming window."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
