"""Queries whose results SQL cannot compute, held against what SQL can say of them: sizes, lengths, recall, months, kept words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, forecast, measures, stats, trees, vectors
from ..operators.written import written
from .library import _NEAREST, _lists
from .registry import register
from .tables import table

_AHEAD = 6


def _nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values of each nation's customers by month, months without an order as 0."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s"))
    rows = table(spark, sf_dir, "orders").where("o_orderdate is not null").join(customer, "o_custkey")
    months = rows.groupBy("s", F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.sum("o_totalprice").alias("v"))
    return forecast.complete_months(months, ["s"])


@register("candidate_forecasts", f"""
WITH m AS (SELECT c_nationkey AS s, date_trunc('month', min(o_orderdate)::date) AS a, date_trunc('month', max(o_orderdate)::date) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate IS NOT NULL GROUP BY 1),
n AS (SELECT *, date_diff('month', a, b) + 1 AS n FROM m)
SELECT s, n AS months, '{','.join(sorted([*forecast.MODELS, *trees.TREES]))}' AS tried, {_AHEAD} AS ahead, strftime(b + INTERVAL 1 MONTH, '%Y-%m') AS first_month, strftime(b + INTERVAL {_AHEAD} MONTH, '%Y-%m') AS last_month, true AS by_the_least, true AS finite
FROM n WHERE n >= {forecast.FEWEST}""")
def candidate_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates for each nation's months, two of which learn from all nations; the best one's months ahead."""
    series = written(_nation_months(spark, sf_dir), "series")
    made = trees.chosen(["s"], forecast.forecast(series, ["s"], _AHEAD), trees.forecast_trees(series, ["s"], _AHEAD))
    model, future = F.col("kind") == "model", F.col("kind") == "future"
    told = made.groupBy("s").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(model, F.col("model")))), ",").alias("tried"), F.count_if(future).alias("ahead"), F.min("ym").alias("first_month"), F.max("ym").alias("last_month"),
        (F.min(F.when(model, F.col("rmse"))) == F.max(F.when(future, F.col("rmse")))).alias("by_the_least"), F.every(~future | (F.abs("v") < float("inf"))).alias("finite"),
    )
    return told.join(series.groupBy("s").agg(F.count(F.lit(1)).alias("months")), "s")


@register("cluster_sizes", "SELECT count(*) AS parts, round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice), 4) AS mean_price, true AS in_one FROM part")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and means of the clusters of parts, put together again."""
    part = table(spark, sf_dir, "part")
    placed, k, _ = stats.clusters(part, measures.measures(part, ["p_size", "p_retailprice"]), 4)
    each = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"))
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return each.agg(F.sum("n").alias("parts"), F.round(mean("a"), 6).alias("mean_size"), F.round(mean("b"), 4).alias("mean_price"), (F.count(F.lit(1)) == k).alias("in_one"))


_WORDS = r"regexp_extract_all({}, '[^\s]+')"


@register("rejoined_chunks", rf"""
SELECT doc_id, md5(array_to_string(list_sort(list_distinct({_WORDS.format('text')})), ' ')) AS words, true AS short, true AS numbered
FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\s]')""")
def rejoined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all chunks of each document, which are those of its text: nothing is lost or made up."""
    made = chunks.chunks(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("source")), "source", "text")
    rows = made.select("doc_id", "chunk", "chunk_index", F.regexp_extract_all("chunk", F.lit(r"[^\s]+"), F.lit(0)).alias("w"))
    told = rows.groupBy("doc_id").agg(
        F.md5(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))), " ").cast("binary")).alias("words"), F.every(F.length("chunk") <= chunks.SIZE).alias("short"),
        (F.max("chunk_index") + 1 == F.count_distinct("chunk_index")).alias("numbered"),
    )
    return told


@register("vector_lengths", """
SELECT item_id AS key, 1.0::double AS length, true AS inside FROM benchmark WHERE regexp_matches(lower(coalesce(text, '')), '[a-z0-9_一-鿿]')""")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the hashed vectors of the benchmark items, with their dimensions within bounds and once each."""
    made = vectors.embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text"))
    inside = F.every(F.col("dim").between(0, max(vectors.LEAST_DIMENSIONS, vectors.DIMENSIONS) - 1)) & (F.count_distinct("dim") == F.count(F.lit(1)))
    return made.groupBy("key").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 9).alias("length"), inside.alias("inside"))


@register("neighbour_recall", f"SELECT count(DISTINCT query) AS queries, true AS nine_of_ten, true AS same_scores FROM ({_NEAREST})")
def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether inverted lists find nine of ten of the five nearest that all lists together give, with the same scores."""
    index, asked = _lists(spark, sf_dir, exact_below=0)
    exact = index.search(asked, 5, reach=2.0).select("query", "key", F.col("score").alias("exact"))
    found = index.search(asked, 5).select("query", "key", "score")
    both = exact.join(found, ["query", "key"], "left")
    return both.agg(
        F.count_distinct("query").alias("queries"), (F.count("score") >= 0.9 * F.count("exact")).alias("nine_of_ten"), F.every(F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-9, F.lit(True))).alias("same_scores")
    )
