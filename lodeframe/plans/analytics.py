"""Statistics, masking, retrieval and synchronisation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masking import MAIL, mask_text
from ..functions.numbers import to_number
from ..functions.text import estimate_tokens, word_count
from ..operators import postings, retrieval, stats
from ..streaming.sync import changes, latest
from .registry import register
from .tables import table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("profile_lineitem", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, round(1 - count({c}) / count(*)::double, 6) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS least,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS most,
  round(stddev_samp({c}) / nullif(avg({c}), 0), 6) AS cv, round(3 * (avg({c}) - quantile_cont({c}, 0.5)) / stddev_samp({c}), 6) AS skew FROM lineitem""" for c in MEASURES))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.profile(table(spark, sf_dir, "lineitem"), MEASURES))


_PAIRS = [(a, b) for n, a in enumerate(MEASURES) for b in MEASURES[n + 1 :]]
_GRADE = "CASE WHEN abs(r) >= 0.9 THEN '极强' WHEN abs(r) >= 0.7 THEN '强' WHEN abs(r) >= 0.4 THEN '中等' WHEN abs(r) >= 0.2 THEN '弱' ELSE '极弱/无' END"


def _correlation_sql(source: str) -> str:
    return f"SELECT a, b, round(r, 6) AS r, {_GRADE} AS grade FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source}" for a, b in _PAIRS) + ")"


@register("correlation_pearson", _correlation_sql("lineitem"))
def correlation_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlations(table(spark, sf_dir, "lineitem"), MEASURES))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS {c}" for c in MEASURES)


@register("correlation_spearman", f"WITH ranked AS (SELECT {_RANKS} FROM lineitem) " + _correlation_sql("ranked"))
def correlation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlations(table(spark, sf_dir, "lineitem"), MEASURES, "spearman"))


@register("outlier_votes", """
WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS l, quantile_cont(value, 0.5) AS q, quantile_cont(value, 0.75) AS h FROM events),
d AS (SELECT quantile_cont(abs(value - q), 0.5) AS mad FROM events, b),
v AS (SELECT event_id, value, abs(value - m) / s AS z, abs(value - m) / s > 3 AS by_z, value < l - 1.5 * (h - l) OR value > h + 1.5 * (h - l) AS by_range, 0.6745 * abs(value - q) / mad > 3.5 AS by_median FROM events, b, d WHERE value IS NOT NULL)
SELECT event_id, value, round(z, 6) AS z, by_z, by_range, by_median, by_z::int + by_range::int + by_median::int AS votes FROM v""")
def outlier_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes that a formula states, of every event."""
    voted = stats.outlier_votes(table(spark, sf_dir, "events").select("event_id", "value"), "value", forest=False)
    return voted.select("event_id", "value", F.round("z", 6).alias("z"), "by_z", "by_range", "by_median", "votes")


@register("forest_outliers")
def forest_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two votes or more of the three, the isolation forest's among them."""
    voted = stats.outlier_votes(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return voted.where("votes >= 2").select("event_id", "value", F.round("z", 6).alias("z"), "by_z", "by_range", "by_forest", "votes")


@register("clean_numbers", """
SELECT o_orderkey, o_totalprice AS plain, -o_totalprice AS wrapped, floor(o_totalprice / 1000)::double AS percent FROM orders""")
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as dirty text and read back."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", to_number(F.concat(F.lit("$ "), F.format_number(price, 2))).alias("plain"), to_number(F.concat(F.lit("("), F.format_number(price, 2), F.lit(")"))).alias("wrapped"),
        to_number(F.concat(F.floor(price / 1000).cast("string"), F.lit("%"))).alias("percent"),
    )


@register("mask_mail", r"""
SELECT doc_id, md5(regexp_replace(text, '([A-Za-z\d])[\w.%+-]*@((?:[A-Za-z\d-]+\.)+[A-Za-z\d-]+)', '\1***@\2', 'g')) AS masked FROM documents""")
def mask_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail rule alone; DuckDB's expressions can't look behind, as the number rules do."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mask_text("text", [MAIL])).alias("masked"))


@register("mask_documents")
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mask_text("text").alias("masked"))


#: Sentences that stand beside the documents, which have no CJK characters.
CHINESE = ["员工报销流程需要提交发票", "出差乘坐飞机经济舱,并住宿标准酒店 3 晚", "请问咖啡机的水箱怎么清洗呢？", "是的", "报", "ab报销_9 cash", ""]
_MIXED = "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}, '{t}')" for k, t in enumerate(CHINESE, 1)) + ") AS v(doc_id, text))"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents and of the Chinese sentences, numbered -1, -2 and so on."""
    own = spark.createDataFrame([(-k, t) for k, t in enumerate(CHINESE, 1)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)


@register("estimate_tokens", f"""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.4::double + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4.0::double)::bigint + 1 END AS tokens FROM {_MIXED}""")
def estimate_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("doc_id", estimate_tokens("text").alias("tokens"))


@register("word_counts", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> ''))::bigint + length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) AS words FROM """ + _MIXED)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("doc_id", word_count("text").alias("words"))


_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"


@register("tfidf_benchmark_items", f"""
WITH d AS (SELECT doc_id AS key, unnest({_TOKENS.format('text')}) AS token FROM documents),
c AS (SELECT key, token, count(*) AS tf FROM d GROUP BY ALL),
i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::double) + 1 AS idf FROM c GROUP BY token),
w AS (SELECT key, c.token, tf * idf * CASE WHEN length(c.token) = 1 THEN 0.5::double ELSE 1 END AS v FROM c JOIN i USING (token)),
n AS (SELECT key, sqrt(sum(v * v)) AS norm FROM w GROUP BY key),
q AS (SELECT query, token, count(*) AS tf FROM (SELECT item_id AS query, unnest({_TOKENS.format('text')}) AS token FROM benchmark WHERE item_id % 50 = 0) GROUP BY ALL),
a AS (SELECT query, q.token, tf * coalesce(idf, 0) * CASE WHEN length(q.token) = 1 THEN 0.5::double ELSE 1 END AS qv FROM q LEFT JOIN i USING (token)),
s AS (SELECT query, sqrt(sum(qv * qv)) AS qnorm, count(*) AS qn FROM a GROUP BY query),
m AS (SELECT query, key, sum(v * qv) AS dot, count(*) AS hit FROM w JOIN a USING (token) GROUP BY ALL),
f AS (SELECT query, key, dot / (norm * qnorm) * (0.45::double + 0.55::double * hit / qn) AS score FROM m JOIN s USING (query) JOIN n USING (key))
SELECT query, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM f WHERE score > 0) WHERE place <= 1""")
def tfidf_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document for every benchmark item whose id is divisible by 50, a stated query set."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text")
    top = retrieval.best(retrieval.tfidf(docs, asked), 1)
    return top.select("query", "key", F.round("score", 6).alias("score"))


_ALL_ITEMS = """
WITH d AS (SELECT doc_id AS key, unnest(TOKENS) AS token FROM documents),
c AS (SELECT key, token, count(*) AS tf FROM d GROUP BY ALL),
i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::double) + 1 AS idf FROM c GROUP BY token),
w AS (SELECT key, c.token, tf * idf * CASE WHEN length(c.token) = 1 THEN 0.5::double ELSE 1 END AS v FROM c JOIN i USING (token)),
n AS (SELECT key, sqrt(sum(v * v)) AS norm FROM w GROUP BY key),
q AS (SELECT query, token, count(*) AS tf FROM (SELECT item_id AS query, unnest(TOKENS) AS token FROM benchmark) GROUP BY ALL),
a AS (SELECT query, q.token, tf * coalesce(idf, 0) * CASE WHEN length(q.token) = 1 THEN 0.5::double ELSE 1 END AS qv FROM q LEFT JOIN i USING (token)),
s AS (SELECT query, sqrt(sum(qv * qv)) AS qnorm, count(*) AS qn FROM a GROUP BY query),
m AS (SELECT query, key, sum(v * qv) AS dot, count(*) AS hit FROM w JOIN a USING (token) GROUP BY ALL),
f AS (SELECT query, key, round(dot / (norm * qnorm) * (0.45::double + 0.55::double * hit / qn), 9) AS score FROM m JOIN s USING (query) JOIN n USING (key))
SELECT query, round(score, 6) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM f WHERE score > 0) WHERE place <= 3 GROUP BY ALL""".replace("TOKENS", _TOKENS.format("text"))


@register("indexed_benchmark_items", _ALL_ITEMS)
def indexed_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the three best documents for every benchmark item, by a text index written for it; copies of a document share a score."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    top = postings.build(docs).search(asked, 3)
    return top.groupBy("query", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@register("nearest_vectors", """
WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS key, list_cosine_similarity(e::double[], embedding::double[]) AS score FROM q, embeddings)
SELECT query, key, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50, a stated query set."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = vectors.where("key % 50 = 0").select(F.col("key").alias("query"), "vector")
    return retrieval.nearest(vectors, asked, 5).select("query", "key", F.round("score", 6).alias("score"), "place")


@register("fuse_rankings", """
WITH a AS (SELECT c_nationkey AS query, c_custkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer),
b AS (SELECT c_nationkey AS query, c_custkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment) DESC, c_custkey) AS place FROM customer)
SELECT query, key, round(sum(1.0::double / (60 + place)), 9) AS score FROM (SELECT * FROM a WHERE place <= 8 UNION ALL SELECT * FROM b WHERE place <= 8) GROUP BY ALL""")
def fuse_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("a"), F.length("c_mktsegment").alias("b"))
    lists = [retrieval.best(rows.select("query", "key", F.col(c).alias("score")), 8) for c in ("a", "b")]
    return retrieval.fuse(lists).select("query", "key", F.round("score", 9).alias("score"))


@register("diversify_hits", """
WITH h AS (SELECT c_nationkey AS query, c_custkey AS key, c_mktsegment AS source, c_acctbal AS score FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, key) AS own FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM o WHERE own <= 3)
SELECT query, key, source, score, place FROM p WHERE place <= 5""")
def diversify_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("source"), F.col("c_acctbal").alias("score"))
    return retrieval.diversify(hits, "source", 5)


@register("sync_changes", """
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice THEN 'written' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (o_orderkey)""")
def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the orders compared: some left out of either, some repriced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return changes(orders.where("o_orderstatus <> 'O'"), orders.where("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", price), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@register("latest_event_per_user", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return latest(events, "user_id", "at").select("user_id", "event_id", "event_type")


@register("repeated_event_runs", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = a AND a = b""")
def repeated_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third and later of the same event in a row by a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    return events.where("event_type = a and a = b").select("user_id", "event_id")
