"""Queries over the rest of the library: measures, forecasts, vectors, tokens, catalogs, shown results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masking, text
from ..functions.numbers import coerce, numeric_votes, to_number
from ..operators import chunks, forecast, lineage, measures, retrieval, stats, vectors
from ..operators.compare import number_matches, numbers_in
from ..operators.written import scratch, written
from ..sources import blocks, files, knowledge
from ..streaming import keyed, masker, slots, sync
from .analytics import _MIXED, mixed
from .recipes import MONTH
from .registry import register
from .tables import table


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Measures

_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
_FACTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS r, count(v) AS f, count(DISTINCT v) AS d, coalesce(bool_and(v = floor(v)), true) AS w FROM (SELECT try_cast({c} AS double) AS v FROM lineitem)" for c in _COLUMNS
)


@register("measure_columns", f"""
SELECT "column", round(1 - f / r::double, 6) AS missing, CASE WHEN 1 - f / r::double > 0.6 THEN 'missing' WHEN regexp_matches("column", '(^|_)(id|ids|code|no|num|seq|status|flag|version|is_[a-z_]+)($|_)') THEN 'id, code or status'
  WHEN f = 0 THEN 'no number' WHEN w AND f >= 30 AND d / f::double > 0.95 THEN 'hardly repeats' WHEN w AND f >= 20 AND d <= 2 THEN 'two values' ELSE '' END AS reason FROM ({_FACTS})""")
def measure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.measure_report(table(spark, sf_dir, "lineitem"), _COLUMNS))


@register("analyse_parts", """
WITH v AS (SELECT p_size::double AS a, p_retailprice AS b FROM part)
SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(a, b), 6) AS r FROM v""")
def analyse_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest correlations among the measures of the parts."""
    return _rounded(measures.analyse(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])[1].select("a", "b", "r"))


@register("anomalous_events", """
WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS l, quantile_cont(value, 0.5) AS q, quantile_cont(value, 0.75) AS h FROM events),
d AS (SELECT quantile_cont(abs(value - q), 0.5) AS mad FROM events, m),
v AS (SELECT 'E' || event_id AS name, value, abs(value - m) / s AS z, (abs(value - m) / s > 3)::int + (value < l - 1.5 * (h - l) OR value > h + 1.5 * (h - l))::int + (0.6745 * abs(value - q) / mad > 3.5)::int AS votes FROM events, m, d),
t AS (SELECT *, max(votes) OVER () AS most, row_number() OVER (ORDER BY votes DESC, z DESC, name) AS k FROM v WHERE votes >= 1)
SELECT CASE WHEN length(name) <= 2 THEN left(name, 1) || '*' ELSE left(name, 1) || repeat('*', length(name) - 2) || right(name, 1) END AS user_name, value, round(z, 6) AS z, votes FROM t WHERE k <= 15 AND ((most >= 2 AND votes >= 2) OR (most < 2 AND k <= 5))""")
def anomalous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of outliers by the three votes that SQL states, its labels masked as names."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("customer_name"), "value")
    found = measures.anomalies(rows, "value", "customer_name", forest=False)
    return found.select(F.col("customer_name").alias("user_name"), "value", F.round("z", 6).alias("z"), "votes")


@register("part_clusters")
def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portraits of the clusters of parts by size and price."""
    return _rounded(measures.grouped(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 4)[0])


@register("chart_points", """
WITH s AS (SELECT * FROM (SELECT o_custkey::text AS label, o_totalprice AS price, o_orderkey AS o FROM orders ORDER BY o LIMIT 200)),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o) AS k FROM s)
SELECT place, label, price FROM (SELECT row_number() OVER (ORDER BY o) AS place, label, price FROM f WHERE k = 1) WHERE place <= 150""")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.col("o_totalprice").alias("price"), "o_orderkey")
    x, ys = measures.chart_axes(rows.limit(500), "o_custkey", "price")
    return measures.chart_points(rows, x, ys, "o_orderkey")


@register("quantile_prices", """
SELECT quantile_cont(p_retailprice, 0.1) AS p10, quantile_cont(p_retailprice, 0.9) AS p90 FROM part""")
def quantile_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.quantiles(stats.long_form(table(spark, sf_dir, "part"), ["p_retailprice"]), [0.1, 0.9])
    return q.select(F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p90"))


@register("price_regression", """
SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS base FROM part GROUP BY 1""")
def price_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("slope"), F.regr_intercept("p_retailprice", "p_size").alias("base")))


# Forecasts

_LAGS = 4


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("s"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.sum("o_totalprice").alias("v"))


_SERIES = f"(SELECT o_orderpriority AS s, {MONTH} AS ym, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


@register("forecast_features", f"""
SELECT s, ym, round(v, 2) AS v, (row_number() OVER w - 1)::int AS i, round(sin(2 * pi() * (substr(ym, 6, 2)::int - 1) / 12), 9) + 0.0 AS sin, round(cos(2 * pi() * (substr(ym, 6, 2)::int - 1) / 12), 9) + 0.0 AS cos,
  {', '.join(f"round(coalesce(lag(v, {d}) OVER w, 0), 2) AS lag{d}" for d in range(1, _LAGS + 1))} FROM {_SERIES} WINDOW w AS (PARTITION BY s ORDER BY ym)""")
def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecast.features(_series(spark, sf_dir), ["s"], _LAGS)
    return made.select("s", "ym", F.round("v", 2).alias("v"), "i", *[(F.round(c, 9) + 0.0).alias(c) for c in ("sin", "cos")], *[F.round(f"lag{d}", 2).alias(f"lag{d}") for d in range(1, _LAGS + 1)])


@register("forecast_errors", f"""
WITH g AS (SELECT s, ym, v, lag(v, 12) OVER (PARTITION BY s ORDER BY ym) AS p FROM {_SERIES})
SELECT s, round(sqrt(avg(pow(v - p, 2))), 4) AS rmse, round(avg(abs(v - p)), 4) AS mae, round(100 * avg(abs(v - p) / greatest(abs(v), 1e-9::double)), 6) AS mape FROM g WHERE p IS NOT NULL GROUP BY s""")
def forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of guessing each month by the same month of the year before."""
    guess = F.lag("v", 12).over(Window.partitionBy("s").orderBy("ym"))
    rows = _series(spark, sf_dir).withColumn("p", guess).where("p is not null")
    return rows.groupBy("s").agg(*forecast.errors(F.col("v"), F.col("p"))).select("s", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"))


@register("forecast_orders")
def forecast_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and six months ahead of each order priority, with the change to the month before."""
    series = written(_series(spark, sf_dir), "series")
    return forecast.report(series, forecast.forecast(series, ["s"], 6), ["s"])


@register("complete_months", """
WITH m AS (SELECT event_type AS s, strftime(ts, '%Y-%m') AS ym, sum(value) AS v FROM events WHERE user_id % 7 = 1 GROUP BY ALL)
SELECT s, ym, round(v, 4) AS v FROM m""")
def complete_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("user_id % 7 = 1").groupBy(F.col("event_type").alias("s"), F.date_format("ts", "yyyy-MM").alias("ym")).agg(F.sum("value").alias("v"))
    return forecast.complete_months(rows, ["s"]).select("s", "ym", F.round("v", 4).alias("v"))


# Tokens

_LOW = "lower(coalesce(text, ''))"
_WORDS, _RUNS = f"regexp_extract_all({_LOW}, '[a-z0-9_]+')", f"regexp_extract_all({_LOW}, '[一-鿿]+')"


def _sql_grams(n: int) -> str:
    return f"flatten(list_transform(list_filter({_RUNS}, lambda r: length(r) >= {n}), lambda r: list_transform(range(1, length(r) - {n} + 2), lambda i: substr(r, i, {n}))))"


def _digest(tokens: str) -> str:
    return f"SELECT doc_id, len({tokens})::int AS n, md5(array_to_string(list_sort({tokens}), ' ')) AS digest FROM {_MIXED}"


def _digested(df: DataFrame, tokens) -> DataFrame:
    return df.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@register("tokens_words", _digest(f"list_concat({_WORDS}, {_sql_grams(1)}, {_sql_grams(2)})"))
def tokens_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(mixed(spark, sf_dir), text.tokens("text"))


_TOLD = "list_filter({}, lambda g: NOT regexp_full_match(g, '[" + text.PHRASE_STOP + "]+'))"


@register("tokens_phrases", _digest(f"list_concat({_WORDS}, {', '.join(_TOLD.format(_sql_grams(n)) for n in (1, 2, 3))}, list_filter({_RUNS}, lambda r: length(r) BETWEEN 2 AND 6))"))
def tokens_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(mixed(spark, sf_dir), text.phrase_tokens("text"))


@register("tokens_pairs", _digest(f"list_concat({_WORDS}, list_filter({_RUNS}, lambda r: length(r) = 1), {_sql_grams(2)})"))
def tokens_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(mixed(spark, sf_dir), text.pair_tokens("text"))


_PIECES = f"list_filter(string_split(regexp_replace({_LOW}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' '), lambda p: p <> '')"


@register("tokens_cover", _digest(f"list_distinct(list_concat(list_filter({_PIECES}, lambda p: length(p) > 1 AND NOT regexp_matches(p, '[一-鿿]')), list_filter(regexp_extract_all(array_to_string(list_filter({_PIECES}, lambda p: regexp_matches(p, '[一-鿿]')), ''), '.'), lambda c: NOT regexp_matches(c, '[{text.COVER_STOP}]'))))"))
def tokens_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(mixed(spark, sf_dir), text.cover_tokens("text"))


@register("rewritten_questions", """
WITH a AS (SELECT s_suppkey, ['请问', '麻烦你帮我看看', '', '我想知道'][s_suppkey % 4 + 1] || s_name || ['是什么呢？', '的销售额吧', ''][s_suppkey % 3 + 1] AS q FROM supplier UNION ALL SELECT -n_nationkey - 1, '谢谢' FROM nation)
SELECT s_suppkey AS id, q, CASE WHEN b = '' THEN q ELSE b END AS asked FROM (SELECT s_suppkey, q, trim(regexp_replace(regexp_replace(q, '^(?:请问|麻烦你|帮我看看|帮我|我想问一下|我想知道|想问一下|能不能|拜托|帮忙)+', ''), '谢谢|打扰了|麻烦了|来着|的话|吗|呢|啊|呀|哦|吧|嗯', '', 'g'), ' ，,。.？?、') AS b FROM a)""")
def rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polite questions about the suppliers, and one word of thanks for each nation, which is all that is left of it."""
    key = F.col("s_suppkey")
    polite = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (key % n + 1).cast("int"))
    q = F.concat(polite(["请问", "麻烦你帮我看看", "", "我想知道"], 4), F.col("s_name"), polite(["是什么呢？", "的销售额吧", ""], 3))
    asked = table(spark, sf_dir, "supplier").select(key.alias("id"), q.alias("q"))
    thanks = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).alias("id"), F.lit("谢谢").alias("q"))
    return asked.unionByName(thanks).select("id", "q", text.rewritten("q").alias("asked"))


@register("repeated_lines_in_texts", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
y AS (SELECT *, regexp_replace(regexp_replace(line, '[ \t\n\v\f\r　]+', '', 'g'), '^[-*•·◦0-9.、）)]+', '') AS key FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY k) AS n FROM y)
SELECT doc_id, count(*) FILTER (length(key) < 6 OR n = 1)::int AS kept FROM f GROUP BY doc_id""")
def repeated_lines_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.without_repeated_lines("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(kept, "\n")).alias("kept"))


@register("digests", "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s, sha256(p_name) AS t FROM part")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("m"), F.sha1("p_name").alias("s"), F.sha2("p_name", 256).alias("t"))


@register("unit_numbers", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 10000.0::double WHEN 1 THEN p_size * 100000000.0::double WHEN 2 THEN p_size::double WHEN 3 THEN p_size * 1000.0::double END AS first, p_partkey % 5 IN (0, 1, 3) AS fits FROM part""")
def unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts told with units, read back; a percentage that is told wrong, and a text without a number, don't fit."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("约 "), size, F.lit(" 万元"))).when(kind == 1, F.concat(size, F.lit(" 亿"))).when(kind == 2, F.concat(F.lit("涨了 "), size, F.lit("%"))).when(kind == 3, F.concat(size, F.lit("千"))).otherwise("没有数")
    truth = F.col("p_size") * F.when(kind == 0, 1e4).when(kind == 1, 1e8).when(kind == 2, 1e5).otherwise(1e3)
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("t"), truth.alias("truth"))
    return rows.select("p_partkey", F.get(numbers_in("t"), F.lit(0)).alias("first"), number_matches("t", "truth").alias("fits"))


# Vectors


@register("dimension_frequency", """
WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT dim::int AS dim, count(*) AS df, round(ln(((SELECT count(*) FROM embeddings) + 1) / (count(*) + 1)::double), 9) AS idf FROM e WHERE x <> 0 GROUP BY dim""")
def dimension_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dimension_idf(vectors.sparse(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select("dim", "df", F.round("idf", 9).alias("idf"))


@register("nearest_by_idf", """
WITH e AS (SELECT vec_id AS key, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT key, dim, CASE WHEN x > 0.1 THEN x END AS x FROM e),
k AS (SELECT * FROM c WHERE x IS NOT NULL),
i AS (SELECT dim, ln(((SELECT count(DISTINCT key) FROM k) + 1) / (count(*) + 1)::double) AS idf FROM k GROUP BY dim),
w AS (SELECT key, k.dim, x * idf AS w FROM k JOIN i USING (dim)), n AS (SELECT key, sqrt(sum(w * w)) AS n FROM w GROUP BY key),
s AS (SELECT q.key AS query, w.key, sum(q.w * w.w) AS dot FROM w JOIN w q USING (dim) WHERE q.key % 50 = 0 GROUP BY ALL),
r AS (SELECT query, s.key, dot / (a.n * b.n) AS score FROM s JOIN n a ON a.key = query JOIN n b ON b.key = s.key)
SELECT query, key, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM r WHERE score > 0) WHERE place <= 5""")
def nearest_by_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest, by idf-weighed cosine of the entries above 0.1, of every vector whose id is divisible by 50."""
    entries = vectors.sparse(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").where("value > cast(0.1 as double)")
    asked = entries.where("key % 50 = 0").withColumnRenamed("key", "query")
    return vectors.search(entries, asked, 5).select("query", "key", F.round("score", 6).alias("score"), "place")


@register("hashed_vectors")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hashed vectors of the benchmark items."""
    return vectors.embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text"))


_NEAREST = """
WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS key, list_cosine_similarity(e::double[], embedding::double[]) AS score FROM q, embeddings)
SELECT query, key, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM s WHERE score > 0) WHERE place <= 5"""


def _lists(spark: SparkSession, sf_dir: str, **options) -> tuple[vectors.InvertedLists, DataFrame]:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return vectors.InvertedLists(own, **options), own.where("key % 50 = 0").withColumnRenamed("key", "query")


@register("indexed_neighbours", _NEAREST)
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50, by the index, whose lists are opened as far as an exact answer needs."""
    index, asked = _lists(spark, sf_dir)
    return _rounded(index.exactly(asked, 5))


@register("listed_neighbours")
def listed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by inverted lists, however few vectors there are, opened as far as held queries ask for."""
    index, asked = _lists(spark, sf_dir, exact_below=0)
    return _rounded(index.search(asked, 5))


@register("all_lists_neighbours", _NEAREST)
def all_lists_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every list opened, which gives the exact answer."""
    index, asked = _lists(spark, sf_dir, exact_below=0)
    return _rounded(index.search(asked, 5, reach=2.0))


@register("mismatched_vectors", "SELECT vec_id FROM embeddings WHERE coalesce(len(embedding), -1) <> 60")
def mismatched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mismatched(table(spark, sf_dir, "embeddings"), "embedding", 60).select("vec_id")


# Retrieval

_CATALOG = "(SELECT p_partkey AS key, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part)"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


@register("recalled_parts", f"""
WITH h AS (SELECT DISTINCT key, unnest({_TOK.format('t')}) AS token FROM {_CATALOG}),
i AS (SELECT token, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 0.5::double)) AS idf FROM h GROUP BY token),
a AS (SELECT DISTINCT s_suppkey AS query, unnest({_TOK.format("'brand#' || (s_suppkey % 30) || ' ' || s_name")}) AS token FROM supplier WHERE s_suppkey % 50 = 0),
n AS (SELECT query, count(*) AS n FROM a GROUP BY query)
SELECT query, key, round(sum(idf), 6) AS score, count(*) AS matched FROM h JOIN a USING (token) JOIN i USING (token) JOIN n USING (query) GROUP BY query, key, n HAVING sum(idf) >= 1.5 OR count(*) >= 0.5 * n""")
def recalled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query"), F.concat(F.lit("brand#"), (F.col("s_suppkey") % 30).cast("string"), F.lit(" "), F.col("s_name")).alias("text"))
    return _rounded(retrieval.recall_tables(_parts(spark, sf_dir), asked))


@register("reranked_hits", """
WITH h AS (SELECT n_regionkey AS query, n_nationkey AS key, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation),
t AS (SELECT query, key, place, count(*) OVER (PARTITION BY query) AS n, list_distinct(list_filter(string_split(regexp_replace(lower(n_name), '[^a-z0-9_]', ' ', 'g'), ' '), lambda w: length(w) > 1)) AS own,
  list_distinct(list_filter(string_split(regexp_replace(lower(r_name || ' nation nation_1 1'), '[^a-z0-9_]', ' ', 'g'), ' '), lambda w: length(w) > 1)) AS q FROM h JOIN region ON r_regionkey = query)
SELECT query, key, round(0.7 * len(list_intersect(q, own)) / len(q)::double + 0.3::double * (1 - (place - 1) / n::double), 6) AS score FROM t""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    hits = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query"), F.col("n_nationkey").alias("key"), "n_name", place.alias("place"))
    joined = hits.join(table(spark, sf_dir, "region"), F.col("query") == F.col("r_regionkey"))
    ranked = retrieval.rerank_by_coverage(joined, F.concat("r_name", F.lit(" nation nation_1 1")), F.col("n_name"))
    return _rounded(ranked.select("query", "key", "score"))


@register("evidence_hits", "SELECT c_custkey, s FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 10000 END AS s FROM customer) WHERE s IS NULL OR s >= 0.15")
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 10000)
    return retrieval.with_evidence(table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))).select("c_custkey", F.col("score").alias("s"))


@register("pooled_hits", """
SELECT query, key, max(score) AS score, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines FROM (SELECT c_nationkey AS query, c_custkey AS key, c_acctbal AS score, 'a' AS engine FROM customer
UNION ALL SELECT c_nationkey, c_custkey, c_acctbal / 2, 'b' FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL""")
def pooled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    lists = [own.withColumn("engine", F.lit("a")), own.where("key % 3 = 0").select("query", "key", (F.col("score") / 2).alias("score"), F.lit("b").alias("engine"))]
    return retrieval.best_of(lists).withColumn("engines", F.array_join("engines", ","))


_TERMS = {"信用利差": ["credit spread"], "利差": ["spread"], "咖啡": ["coffee", "latte"], "收入": ["income"]}


@register("expanded_terms", """
WITH q AS (SELECT p_partkey, ['信用利差', '咖啡收入', '无', '利差的咖啡'][p_partkey % 4 + 1] || p_name || ['', '和利差'][p_partkey % 2 + 1] AS q FROM part),
t AS (SELECT p_partkey, list_concat(CASE WHEN q LIKE '%信用利差%' THEN ['credit spread'] ELSE [] END, CASE WHEN replace(q, '信用利差', ' ') LIKE '%利差%' THEN ['spread'] ELSE [] END,
  CASE WHEN q LIKE '%咖啡%' THEN ['coffee', 'latte'] ELSE [] END, CASE WHEN q LIKE '%收入%' THEN ['income'] ELSE [] END) AS t FROM q)
SELECT p_partkey, array_to_string(list_sort(t), ',') AS terms FROM t""")
def expanded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of questions that name a part; a term within a longer one doesn't count again."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(["信用利差", "咖啡收入", "无", "利差的咖啡"]), F.col("p_name"), pick(["", "和利差"])).alias("q"))
    return rows.select("p_partkey", F.array_join(F.array_sort(retrieval.expanded(F.col("q"), _TERMS)), ",").alias("terms"))


@register("experience_hits", """
WITH e AS (SELECT DISTINCT p_partkey AS key, p_size AS hits, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9_]+')) AS token FROM part),
a AS (SELECT DISTINCT r_regionkey AS query, unnest(regexp_extract_all(lower('a brand 1' || r_regionkey), '[a-z0-9_]+')) AS token FROM region),
n AS (SELECT query, count(*) AS n FROM a GROUP BY query), s AS (SELECT query, key, count(*) / any_value(n)::double + 0.05::double * any_value(hits) AS score FROM e JOIN a USING (token) JOIN n USING (query) GROUP BY query, key)
SELECT query, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS k FROM s) WHERE k <= 3""")
def experience_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("text"), F.col("p_size").alias("hits"))
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query"), F.concat(F.lit("a brand 1"), F.col("r_regionkey").cast("string")).alias("text"))
    return _rounded(retrieval.recall_experience(past, asked).select("query", "key", "score"))


@register("memory_scores", """
SELECT p_partkey, round(CASE WHEN h = 0 THEN 0 ELSE h / 2.0::double * 10 + least(p_size, 5) * 0.2::double + least(p_size % 7, 5) * 0.05::double END, 6) AS score
FROM (SELECT p_partkey, p_size, len(list_intersect(['brand', '12'], regexp_extract_all(lower(p_brand), '[a-z0-9_]+'))) AS h FROM part)""")
def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("text"), F.col("p_size").alias("importance"), (F.col("p_size") % 7).alias("uses"))
    return _rounded(notes.select("p_partkey", retrieval.memory_scores(notes, F.lit("Brand 12")).alias("score")))


@register("document_chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents."""
    return chunks.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"), "source", "text")


# Tables and what is shown of them


@register("dumped_tables", """
SELECT r_name AS id, 'markdown' AS kind, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey))::int AS row, n_nationkey || ',' || n_name AS cells FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dumped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as blocks of Markdown tables, one for each region, and read back."""
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = own.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    block = F.concat(F.lit("=== "), "r_name", F.lit(" ===\n```md\n| key | name |\n|---|:-:|\n"), "body", F.lit("\n```\n"))
    dump = lines.agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("dump"))
    rows = blocks.block_tables(dump, "dump").select("id", "kind", F.posexplode("rows").alias("row", "cells")).where("row > 0")
    return rows.withColumn("cells", F.array_join("cells", ","))


@register("quoted_orders", """
SELECT o_orderkey::double AS "order, no", 'say "' || o_orderpriority || '"' || chr(10) || '  and, ' || o_orderstatus AS remark, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN o_clerk_like END AS note
FROM (SELECT *, 'x,' || chr(10) || chr(10) || 'y' AS o_clerk_like FROM orders)""")
def quoted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as quoted text, with delimiters, quotes, blanks and line ends in cells and header, and read back."""
    remark = F.concat(F.lit('say "'), "o_orderpriority", F.lit('"\n  and, '), "o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order, no"), remark.alias("remark"), F.concat(F.lit("$ "), F.format_number("o_totalprice", 2)).alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "x,\n\ny").alias("note"))
    path = f"{scratch(spark)}/orders-{uuid.uuid4().hex}"
    rows.write.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)
    return files.read_delimited(spark, path).select("`order, no`", "remark", "price", "note")


@register("voted_columns", """
SELECT 'code' AS "column", count(*) FILTER (code <> '') AS filled, count(*) FILTER (regexp_full_match(code, '[0-9]+')) AS numeric, false AS is_numeric FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::text ELSE 'x' END AS code FROM orders)
UNION ALL SELECT 'price', count(*), count(*), true FROM orders""")
def voted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("x").alias("code"), F.concat(F.lit("$ "), F.format_number("o_totalprice", 2)).alias("price"))
    return numeric_votes(rows)


@register("coerced_cells", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice) END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'none' END AS price__raw FROM orders""")
def coerced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("¥"), F.format_number(F.floor("o_totalprice"), 0))).otherwise("none")
    return coerce(table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")), ["price"])


_DIRTY = ["({n}.5)", "{n}e5", "+{n}", "(-{n}.5)", "-{n}.5 ( {n}.5 )", "{n}%", "$ {n}.25", "-1,{n}"]


@register("dirty_numbers", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN -(n + 0.5) WHEN 3 THEN n + 0.5 WHEN 4 THEN -(n + 0.5) WHEN 5 THEN n WHEN 6 THEN n + 0.25 END::double AS number FROM (SELECT o_orderkey, o_orderkey % 900 + 100 AS n FROM orders)""")
def dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in eight ways, of which three are none."""
    n = (F.col("o_orderkey") % 900 + 100).cast("string")
    ways = F.array(*[F.replace(F.lit(w), F.lit("{n}"), n) for w in _DIRTY])
    return table(spark, sf_dir, "orders").select("o_orderkey", to_number(F.element_at(ways, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("number"))


@register("masked_columns", """
SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) AS customer_name, '138****' || lpad((c_custkey % 10000)::text, 4, '0') AS contact_phone, c_acctbal AS amount FROM customer""")
def masked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = F.concat(F.lit("1380000"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer_name"), phone.alias("contact_phone"), F.col("c_acctbal").alias("amount"))
    return masking.mask(rows)


@register("masked_sentences", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '身份证号：32**************' || lpad((c_custkey % 100)::text, 2, '0') WHEN 1 THEN '客户李*, 手机138****' || lpad((c_custkey % 10000)::text, 4, '0')
  WHEN 2 THEN '客户满意度高, ' || c_name WHEN 3 THEN '姓名：王**, 联系地址：北京市朝阳区******' ELSE '卡 6222*****' || lpad((c_custkey % 10000)::text, 4, '0') || ' 付 ¥1234567890123' END AS masked FROM customer""")
def masked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about each customer, of five kinds, masked by the rules for free text."""
    key, four = F.col("c_custkey"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    said = (
        F.when(key % 5 == 0, F.concat(F.lit("身份证号：3201011990010112"), F.lpad((key % 100).cast("string"), 2, "0")))
        .when(key % 5 == 1, F.concat(F.lit("客户李雷, 手机1380000"), four))
        .when(key % 5 == 2, F.concat(F.lit("客户满意度高, "), F.col("c_name")))
        .when(key % 5 == 3, F.lit("姓名：王小明, 联系地址：北京市朝阳区建国路88号"))
        .otherwise(F.concat(F.lit("卡 622202111"), four, F.lit(" 付 ¥1234567890123")))
    )
    return table(spark, sf_dir, "customer").select(key, masking.mask_free_text(said).alias("masked"))


@register("streamed_sentences", """
SELECT c_custkey AS stream, '客户李*, 手机138****' || lpad((c_custkey % 10000)::text, 4, '0') || ', ' || c_name AS text FROM customer""")
def streamed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about each customer in pieces of six characters, every other piece two batches late, masked as a stream."""
    said = F.concat(F.lit("客户李雷, 手机1380000"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(", "), F.col("c_name"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("stream"), said.alias("said"))
    cut = own.select("stream", "said", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("said") - 1) / 6).cast("int"))).alias("seq"))
    pieces = cut.select("stream", "seq", F.substring("said", F.col("seq") * 6 + 1, F.lit(6)).alias("chunk"), ((F.col("seq") + 1) * 6 >= F.char_length("said")).alias("last"))
    root = f"{scratch(spark)}/pieces-{uuid.uuid4().hex}"
    for late in (1, 0):
        pieces.where(F.col("seq") % 2 == late).coalesce(1).write.parquet(f"{root}/in/batch={late}")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    with masker.ending_with_data(spark):
        masker.masked_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    parts = spark.read.schema("stream long, part int, text string").parquet(f"{root}/out")
    return parts.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))


@register("capped_orders", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 500 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")
def capped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 rows, however many are asked for, and whether there are more."""
    return lineage.capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 9999)


@register("answered_customers", "SELECT left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) AS customer_name, c_acctbal, (SELECT count(*) FROM customer) > 20 AS truncated FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20")
def answered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("customer_name"), "c_acctbal")
    return lineage.answered(rows, [F.desc("c_acctbal"), "customer_name"], 20)


@register("used_tables", "SELECT name, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS n_rows FROM (VALUES ('customer'), ('nation'), ('orders')) AS v(name)")
def used_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a query over three tables reads, with the rows that it gives."""
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lineage.recorded(df, "joined", "SELECT ...").select(F.explode("tables").alias("name"), "n_rows")


@register("recorded_sources", "SELECT 'query' AS kind, 'big' AS name, 'orders' AS tables, count(*) AS n_rows FROM orders WHERE o_totalprice > 100000")
def recorded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lineage.recorded(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), "big", "SELECT * FROM orders WHERE o_totalprice > 100000").withColumn("at", F.lit(1))
    kept = lineage.merged_sources(made.limit(0), made)
    return kept.select("kind", "name", F.array_join("tables", ",").alias("tables"), "n_rows")


@register("answered_and_recorded", """
SELECT 'query' AS kind, 'big' AS name, 'customer,orders' AS tables, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS n_rows, (SELECT least(20, count(*)) FROM orders WHERE o_totalprice > 100000) AS shown
UNION ALL SELECT 'query', 'small', 'nation', (SELECT count(*) FROM nation), NULL""")
def answered_and_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of two sources, of which one is answered anew over other tables; its rows are counted while it is shown."""
    old = lineage.recorded(table(spark, sf_dir, "customer"), "big", "SELECT 1").unionByName(lineage.recorded(table(spark, sf_dir, "nation"), "small", "SELECT 2")).withColumn("at", F.lit(1))
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    shown, row = lineage.answered_and_recorded(big, [F.desc("o_totalprice"), "o_orderkey"], 20, "big", "SELECT * FROM orders WHERE o_totalprice > 100000")
    kept = lineage.merged_sources(old, row.withColumn("at", F.lit(2)))
    count = shown.agg(F.count(F.lit(1)).alias("__shown"))
    return kept.crossJoin(F.broadcast(count)).select("kind", "name", F.array_join("tables", ",").alias("tables"), "n_rows", F.when(F.col("name") == "big", F.col("__shown")).alias("shown"))  # one row


@register("sampled_parts", """
SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY md5('42' || chr(31) || p_partkey)) AS k FROM part WHERE p_size > 10) WHERE k <= 500""")
def sampled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.sampled(table(spark, sf_dir, "part"), ["p_partkey", "p_size"], 500, "p_size > 10", ["p_partkey"])


@register("shown_scores", """
SELECT c_nationkey AS query, c_custkey AS key, round(CASE WHEN c_custkey % 3 = 0 THEN (greatest(c_acctbal / 10000, 0) + (c_acctbal / 10000 + 1) / 2) / 2 ELSE greatest(c_acctbal / 10000, 0) END, 9) AS shown FROM customer""")
def shown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 10000).alias("score"))
    return retrieval.shown_scores(own, own.where("key % 3 = 0")).select("query", "key", F.round("shown", 9).alias("shown"))


@register("knowledge_terms", """
WITH t AS (SELECT n_nationkey AS k, n_name || ' ' || r_name || ' nation' AS x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 > 0 UNION ALL SELECT 100 + r_regionkey, r_name || ' region' FROM region),
w AS (SELECT DISTINCT k, unnest(regexp_extract_all(lower(x), '[a-z0-9_]+')) AS token FROM t)
SELECT token, count(*) AS df FROM w GROUP BY token""")
def knowledge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of an index over a folder of texts, after files were added and taken away."""
    root = f"{scratch(spark)}/knowledge-{uuid.uuid4().hex}"
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    told = nations.select(F.concat_ws(" ", "n_name", "r_name", F.lit("nation")).alias("text"), (F.col("n_nationkey") % 5 > 0).alias("stays"), F.col("n_nationkey").alias("k"))
    for stays in (True, False):
        told.where(F.col("stays") == stays).select("text", "k").write.partitionBy("k").text(f"{root}/in/stays={stays}")
    index = knowledge.KnowledgeIndex(spark, f"{root}/in", f"{root}/index")
    index.refresh()
    regions = table(spark, sf_dir, "region").select(F.concat(F.col("r_name"), F.lit(" region")).alias("text"), F.col("r_regionkey").alias("k"))
    regions.write.partitionBy("k").text(f"{root}/in/more")
    slots.remove(spark, f"{root}/in/stays=False")
    index.refresh()
    return index.terms.read()


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "part")}
    return blocks.catalog(own, "sales").unionByName(blocks.catalog({n: table(spark, sf_dir, n) for n in ("nation", "region")}, "places"))


@register("dataset_sizes", """
SELECT dataset, count(*) AS tables, sum(n)::bigint AS n_rows FROM (SELECT 'sales' AS dataset, count(*) AS n FROM orders UNION ALL SELECT 'sales', count(*) FROM customer UNION ALL SELECT 'sales', count(*) FROM part
UNION ALL SELECT 'places', count(*) FROM nation UNION ALL SELECT 'places', count(*) FROM region) GROUP BY dataset""")
def dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("tables"), F.sum("n_rows").alias("n_rows"))


@register("catalog_by_column", "SELECT * FROM (VALUES ('sales', 'customer', 't_customer_' || left(md5('customer'), 6)), ('places', 'nation', 't_nation_' || left(md5('nation'), 6))) AS v(dataset, source, name)")
def catalog_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.with_column_like(_catalog(spark, sf_dir), "NATIONKEY").select("dataset", "source", "name")


@register("resolved_table", "SELECT 'sales' AS dataset, 'customer' AS source, count(*) AS n_rows FROM customer")
def resolved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.resolve(_catalog(spark, sf_dir).where("dataset = 'sales'"), "Custom").select("dataset", "source", "n_rows")


@register("data_card", """
SELECT 'p_brand' AS "column", 'string' AS dtype, count(p_brand) AS filled, count(DISTINCT p_brand) AS "distinct", (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part ORDER BY b LIMIT CASE WHEN (SELECT count(DISTINCT p_brand) FROM part) <= 8 THEN 8 ELSE 3 END)) AS samples FROM part
UNION ALL SELECT 'p_size', 'int', count(p_size), count(DISTINCT p_size), (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_size::text AS b FROM part ORDER BY b LIMIT CASE WHEN (SELECT count(DISTINCT p_size) FROM part) <= 8 THEN 8 ELSE 3 END)) FROM part""")
def data_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.card(table(spark, sf_dir, "part"), ["p_brand", "p_size"]).withColumn("samples", F.array_join("samples", ","))


@register("search_blobs", """
SELECT left(b || ' | ' || regexp_replace(b, '[_./-]+', ' ', 'g'), 4000) AS blob FROM (SELECT left('r_regionkey | r_name | ' || (SELECT string_agg(r_regionkey || ' ' || r_name, ' | ' ORDER BY r_regionkey) FROM region WHERE r_regionkey < 3)
  || ' | ' || (SELECT string_agg(r_regionkey::text, ' | ' ORDER BY r_regionkey) FROM region) || ' | ' || (SELECT string_agg(r_name, ' | ' ORDER BY r_regionkey) FROM region), 2000) AS b)""")
def search_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.search_blob(["r_regionkey", "r_name"], table(spark, sf_dir, "region"), "r_regionkey")


@register("clean_cells", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, coalesce(trim(event_type), '') AS kind, CASE WHEN length(props) > 500 THEN left(props, 500) || '…' ELSE coalesce(trim(props), '') END AS props FROM events")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = blocks.clean_cell
    return table(spark, sf_dir, "events").select("event_id", cell(F.col("ts"), "timestamp").alias("ts"), cell(F.col("event_type"), "string").alias("kind"), cell(F.col("props"), "string").alias("props"))


# Small relational rows


@register("star_projection", "SELECT * FROM region")
def star_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("*")


@register("quoted_names", """SELECT n_nationkey AS "国家 编号", n_name AS "0" FROM nation""")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("国家 编号"), F.col("n_name").alias("0")).select("`国家 编号`", "`0`")


@register("valid_at_date", """
SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-15' AND o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1996-06-15' AND nullif(o_orderstatus, 'O') IS NULL""")
def valid_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose interval holds a given date and that haven't ended; the date is a parameter, not the clock."""
    as_of = F.lit("1996-06-15").cast("timestamp")
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderdate") <= as_of) & (F.col("o_orderdate") + F.expr("interval 90 days") >= as_of) & F.nullif(F.col("o_orderstatus"), F.lit("O")).isNull()).select("o_orderkey")


@register("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2)")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    some = docs.select("source").distinct().orderBy("source").limit(2)
    return docs.where("lang = 'en'").join(F.broadcast(some), "source", "left_semi").select("doc_id")


@register("bucketed_prices", """
SELECT CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice >= 2000 THEN 6 ELSE floor((p_retailprice - 1000) / 200) + 1 END::bigint AS bucket, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5""")
def bucketed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.width_bucket("p_retailprice", F.lit(1000.0), F.lit(2000.0), F.lit(5))
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@register("kinds_histogram", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def kinds_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("accuracy_by_category", "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::double ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    right = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@register("first_of_each_label", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_of_each_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving removal of repeats: the first row of each label stays."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.struct("ts", "event_id")).alias("a")).select("event_type", "a.event_id")


@register("newest_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "ts")


@register("dated_rows", "SELECT o_orderkey, date_diff('day', o_orderdate::date, DATE '2000-01-01') AS age, try_cast(o_orderpriority AS int) AS none FROM orders")
def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days up to an injected current date, and a cast that gives null for what is no number."""
    today = F.lit("2000-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(today, F.to_date("o_orderdate")).cast("long").alias("age"), F.col("o_orderpriority").try_cast("int").alias("none"))


@register("counted_keys", "SELECT user_id, count(*) AS hits, max(ts) AS last FROM events GROUP BY 1")
def counted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.running_counts(table(spark, sf_dir, "events"), "user_id", "ts")


@register("wasted_repeats", """
WITH c AS (SELECT user_id, event_type, event_id, value > 10 AS ok, lag(value > 10) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS calls, count(*) FILTER (coalesce(before, false)) AS wasted FROM c GROUP BY 1""")
def wasted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of the same call after one that went well."""
    ok = F.col("value") > 10
    before = F.lag(ok).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", F.coalesce(before, F.lit(False)).alias("again"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("again").alias("wasted"))


@register("noted_texts", """
WITH n AS (SELECT event_type, count(*) AS n, max(event_id) AS seen, list_sort(list_distinct(list(CASE WHEN value > 10 THEN 'high' ELSE 'low' END) || ['old'])) AS tags FROM events GROUP BY 1)
SELECT 'About ' || event_type || '.' AS text, array_to_string(tags, ',') AS tags, least(5, 1 + n)::int AS importance, seen FROM n""")
def noted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note on each kind of event, and every event as a new note that says the same with other signs and cases."""
    events = table(spark, sf_dir, "events")
    told = lambda c, end: F.concat(F.lit("About "), c, F.lit(end))
    old = events.select("event_type").distinct().select(told(F.col("event_type"), ".").alias("text"), F.array(F.lit("old")).alias("tags"), F.lit(1).alias("importance"), F.lit(-1).cast("long").alias("seen"))
    new = events.select(told(F.upper("event_type"), " !").alias("text"), F.array(F.when(F.col("value") > 10, "high").otherwise("low")).alias("tags"), F.col("event_id").cast("long").alias("seen"))
    return sync.noted(old, new, "text", "tags", "seen").withColumn("tags", F.array_join("tags", ","))


@register("sync_with_nulls", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 'removed' WHEN 4 THEN 'unchanged' WHEN 1 THEN 'unchanged' ELSE 'written' END AS change FROM orders""")
def sync_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that moves from one column to another is a change; a null that stays is none."""
    kind, status = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders")
    old = orders.where(kind != 3).select("o_orderkey", F.when(kind != 1, status).alias("a"), F.when(kind == 1, status).alias("b"))
    new = orders.where(kind != 2).select("o_orderkey", F.when(~kind.isin(0, 1), status).alias("a"), F.when(kind.isin(0, 1), status).alias("b"))
    return sync.changes(old, new, "o_orderkey", ["a", "b"])


@register("keyed_orders", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND o_orderstatus = 'P')""")
def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken in by four batches: all, new prices for some, the same batch again, and some taken away."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    own = keyed.KeyedTable(spark, f"{scratch(spark)}/keyed-{uuid.uuid4().hex}", "o_orderkey", "o_orderkey long, o_totalprice double", 16)
    own.apply(orders, 0)
    dearer = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    own.apply(dearer, 1)
    own.apply(orders, 1)
    own.apply(orders.where("o_orderkey % 3 <> 0 and o_orderstatus = 'P'").withColumn("gone", F.lit(True)), 2, gone="gone")
    return own.read()


@register("published_tables", """
SELECT 'nation' AS source, count(*) AS n_rows, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) AS joined FROM nation UNION ALL SELECT 'region', count(*), (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) FROM region""")
def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables and their catalog, written as one version and read back: the catalog, with the rows of their join."""
    own = {n: table(spark, sf_dir, n) for n in ("nation", "region")}
    root = f"{scratch(spark)}/published-{uuid.uuid4().hex}"
    slots.publish(own, blocks.catalog(own, "places"), root)
    tables, catalog, _ = slots.published(spark, root)
    joined = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).agg(F.count(F.lit(1)).alias("joined"))
    return catalog.select("source", "n_rows").crossJoin(F.broadcast(joined))  # one row


@register("pruned_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def pruned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return sync.vanished(table(spark, sf_dir, "customer").select("c_custkey"), keep, "c_custkey")


@register("chinese_answers", "SELECT n_nationkey AS query, n_nationkey AS key FROM nation")
def chinese_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both engines, fused, over three kinds of Chinese texts about the nations: a question finds its own nation's."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    nations = table(spark, sf_dir, "nation")
    own_name = F.translate("n_name", " ", "_")
    docs = nations.select(F.col("n_nationkey").alias("key"), F.concat(own_name, pick(["员工报销流程需要提交发票", "出差乘坐飞机经济舱并住宿标准酒店", "咖啡机的水箱需要定期清洗"])).alias("text"))
    asked = nations.select(F.col("n_nationkey").alias("query"), F.concat(pick(["报销流程是什么", "飞机经济舱住宿多少钱", "咖啡机怎么清洗水箱"]), own_name).alias("text"))
    own, theirs = vectors.embed(docs), vectors.embed(asked.withColumnRenamed("query", "key")).withColumnRenamed("key", "query")
    return retrieval.retrieve(docs, own, asked, theirs, 1).select("query", "key")