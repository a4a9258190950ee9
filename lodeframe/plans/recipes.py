"""Analytic question types over the star schema: ratio, change, top, group, count, sum, average, trend and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import register
from .tables import table

MONTH = "strftime(o_orderdate, '%Y-%m')"


def monthly(df: DataFrame, date: str, value: str) -> DataFrame:
    """(ym, v, n): sum of ``value`` and row count by month; rows without a date are left out."""
    return df.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("ym")).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))


def with_change(series: DataFrame) -> DataFrame:
    """Add difference and percent change against the row before; few rows, so one ordered window."""
    before = F.lag("v").over(Window.orderBy("ym"))
    return series.withColumn("diff", F.col("v") - before).withColumn("pct", F.try_divide((F.col("v") - before) * 100.0, before))


@register("trend_monthly_orders", f"""
WITH m AS (SELECT {MONTH} AS ym, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT ym, round(v, 2) AS v, n, round(v - lag(v) OVER (ORDER BY ym), 2) AS diff,
  round((v - lag(v) OVER (ORDER BY ym)) * 100.0 / nullif(lag(v) OVER (ORDER BY ym), 0), 4) AS pct FROM m""")
def trend_monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_change(monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))
    return out.select("ym", F.round("v", 2).alias("v"), "n", F.round("diff", 2).alias("diff"), F.round("pct", 4).alias("pct")).orderBy("ym")


@register("share_by_segment", """
SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal) * 100.0 / (SELECT sum(c_acctbal) FROM customer), 4) AS pct FROM customer GROUP BY c_mktsegment""")
def share_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    parts = customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("part"))
    # One row for each segment by now.
    whole = F.sum("part").over(Window.partitionBy())
    return parts.select("c_mktsegment", "customers", F.round(F.try_divide(F.col("part") * 100.0, whole), 4).alias("pct"))


@register("ratio_returned_revenue", """
SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) * 100.0 / sum(l_extendedprice), 4) AS pct FROM lineitem""")
def ratio_returned_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").agg(F.round(F.try_divide(part * 100.0, F.sum("l_extendedprice")), 4).alias("pct"))


@register("top_customers_by_spend", """
SELECT c_name, round(sum(o_totalprice), 2) AS spend, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, c_name LIMIT 10""")
def top_customers_by_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("orders"))
    named = spend.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return named.orderBy(F.desc("spend"), "c_name").limit(10).select("c_name", F.round("spend", 2).alias("spend"), "orders")


@register("bottom_parts_by_price", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5")
def bottom_parts_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy("p_retailprice", "p_partkey").limit(5).select("p_partkey", "p_name", "p_retailprice")


@register("count_distinct_buyers", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS buyers FROM orders")
def count_distinct_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("buyers"))


@register("group_priority_totals", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average,
  min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def group_priority_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 2).alias("average"), F.min(price).alias("least"), F.max(price).alias("most")
    )


@register("cond_agg_returnflag", """
SELECT l_linestatus, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS max_returned,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS kept_quantity, count(*) FILTER (l_returnflag = 'A') AS accepted FROM lineitem GROUP BY 1""")
def cond_agg_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.max(F.when(flag == "R", F.col("l_extendedprice"))).alias("max_returned"),
        F.sum(F.when(flag == "N", F.col("l_quantity")).otherwise(0.0)).alias("kept_quantity"),
        F.count_if(flag == "A").alias("accepted"),
    )


@register("counterfactual_excl_returns", """
SELECT strftime(l_shipdate, '%Y') AS year, round(sum(l_extendedprice), 2) AS actual,
  round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS without_returns FROM lineitem GROUP BY 1""")
def counterfactual_excl_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy").alias("year")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("actual"), F.round(F.sum(kept), 2).alias("without_returns")
    )


@register("lookup_orders_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 20000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL""")
def lookup_orders_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = (F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 20000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_custkey").isNotNull()
    return table(spark, sf_dir, "orders").where(fits).select("o_orderkey", "o_totalprice")


@register("half_open_range", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'""")
def half_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    inside = (day >= F.lit("1996-01-01").cast("timestamp")) & (day < F.lit("1996-04-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").where(inside).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("like_prefix_infix", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND lower(p_brand) LIKE 'brand#1%'")
def like_prefix_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").like("%A%") & F.col("p_brand").ilike("brand#1%")).select("p_partkey", "p_name")


@register("column_to_column_predicate", "SELECT count(*) AS n FROM lineitem WHERE l_discount > l_tax")
def column_to_column_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_discount") > F.col("l_tax")).agg(F.count(F.lit(1)).alias("n"))


@register("inner_join_region_sales", """
SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def inner_join_region_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    # Nations and regions are fixed dimension tables, small enough for any planner to broadcast.
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    return spend.join(buyers, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("total"))


@register("composite_key_join", """
SELECT a.l_returnflag, count(*) AS n FROM lineitem a JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1""")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return lines.join(last, ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("latest_order_per_customer", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1""")
def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties stay; the newest date is combined before the shuffle, so a busy customer is no bottleneck."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(newest, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey", "o_orderdate")


@register("left_join_order_counts", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("customers_with_big_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def customers_with_big_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@register("having_busy_suppliers", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1 HAVING count(*) > 500")
def having_busy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("quantity"))
    return grouped.where("n > 500")


@register("pivot_status_by_year", """
SELECT strftime(o_orderdate, '%Y') AS year, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def pivot_status_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0)


@register("grouped_topn", """
SELECT n_name, c_custkey, c_acctbal, r FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
JOIN nation ON c_nationkey = n_nationkey WHERE r <= 3""")
def grouped_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")))
    return ranked.where("r <= 3").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_acctbal", "r")


@register("moving_average_orders", f"""
WITH m AS (SELECT {MONTH} AS ym, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT ym, round(avg(v) OVER (ORDER BY ym ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS smooth FROM m""")
def moving_average_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return series.select("ym", F.round(F.avg("v").over(Window.orderBy("ym").rowsBetween(-2, 0)), 2).alias("smooth"))


@register("distinct_brands", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@register("union_hits_keep_best", """
SELECT key, max(score) AS score FROM (SELECT c_custkey AS key, c_acctbal AS score FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier) GROUP BY 1""")
def union_hits_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("score"))
    return a.unionByName(b).groupBy("key").agg(F.max("score").alias("score"))


@register("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@register("multiset_diff", """
SELECT side, k, n FROM (SELECT 'left' AS side, k, count(*) AS n FROM (SELECT o_custkey % 7 AS k FROM orders EXCEPT ALL SELECT c_custkey % 5 FROM customer) GROUP BY k
UNION ALL SELECT 'right', k, count(*) FROM (SELECT c_custkey % 5 AS k FROM customer EXCEPT ALL SELECT o_custkey % 7 FROM orders) GROUP BY k)""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.compare import differences

    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("k"))
    return differences(a, table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("k")))


@register("scalar_functions", """
SELECT o_orderkey, left(o_orderpriority, 1) AS p, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 7) AS ym, year(o_orderdate) AS y, round(o_totalprice, 1) AS price,
  trunc(o_totalprice)::bigint // 7 AS whole, o_totalprice / nullif(o_custkey - o_custkey, 0) AS none FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.col("o_custkey") - F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("p"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 7).alias("ym"), F.year("o_orderdate").alias("y"),
        F.round("o_totalprice", 1).alias("price"), F.expr("cast(o_totalprice as bigint) div 7").alias("whole"), F.try_divide("o_totalprice", zero).alias("none"),
    )


@register("json_property_counts", """
SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.' || json_keys(props)[1])) AS filled FROM events GROUP BY 1""")
def json_property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.json_object_keys("props"), F.lit(0))
    filled = F.element_at(F.from_json("props", "map<string,string>"), first)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(filled).alias("filled"))


@register("catalog_stats", """
SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation""")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"))
    out = one("orders")
    for name in ("customer", "part", "supplier", "nation"):
        out = out.unionByName(one(name))
    return out
