"""Text retrieval with DataFrames: weighted TF-IDF, vectors, fusion, coverage and diversity.

Documents come as (key, text); several queries as (query, text), so one job
answers them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cover_tokens, token_weight, tokens
from .closest import closest
from .written import written

#: Constants of reciprocal-rank fusion, of the coverage factor and of the reranking mix.
RRF, COVERED, RERANK, THRESHOLD = 60, 0.55, 0.7, 0.15


def tfidf(docs: DataFrame, queries: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(query, key, score): cosine of tf · idf · weight, times 0.45 + 0.55 of the query's tokens that the text has.

    idf is ln((N + 1) / (df + 1)) + 1.  Only scores above 0.  The corpus is
    tokenised once and its counts are written: norms need every token, the
    products only those of a query.
    """
    # Texts are fewer bytes than their tokens with keys: they are shuffled, and the counts of a key then lie together for the sums by key.
    split = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key").select("key", F.explode(tokens("text")).alias("token"))
    counts = written(split.groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf")), "counts")
    n = docs.agg(F.count(F.lit(1)).alias("__n"))  # one row
    return tfidf_of(counts, written(inverse_frequency(counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")), n), "idf"), queries)


def inverse_frequency(df: DataFrame, n: DataFrame) -> DataFrame:
    """(token, idf) of (token, df) among ``n``, one row with ``__n`` documents."""
    return df.crossJoin(F.broadcast(n)).select("token", (F.log((F.col("__n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_of(counts: DataFrame, idf: DataFrame, queries: DataFrame) -> DataFrame:
    """tfidf() of a corpus that is counted already: (key, token, tf) and (token, idf)."""
    weighed = counts.join(idf, "token").select("key", "token", (F.col("tf") * F.col("idf") * token_weight("token")).alias("v"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    asked = queries.select("query", F.explode(tokens("text")).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("tf"))
    asked = written(asked.join(idf, "token", "left").select("query", "token", F.col("idf").alias("__idf"), (F.col("tf") * F.coalesce("idf", F.lit(0.0)) * token_weight("token")).alias("qv")), "asked")
    sides = asked.groupBy("query").agg(F.sqrt(F.sum(F.col("qv") * F.col("qv"))).alias("qnorm"), F.count(F.lit(1)).alias("qn"))
    hits = counts.join(asked, "token").select("query", "key", (F.col("tf") * F.col("__idf") * token_weight("token")).alias("v"), "qv")
    met = hits.groupBy("query", "key").agg(F.sum(F.col("v") * F.col("qv")).alias("dot"), F.count(F.lit(1)).alias("hit"))
    scored = met.join(sides, "query").join(norms, "key")
    cosine = F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm"))
    return scored.select("query", "key", (cosine * (1 - COVERED + COVERED * F.col("hit") / F.col("qn"))).alias("score")).where("score > 0")


#: Bytes of query vectors that are compared in one pass over all vectors.
QUERY_BYTES = 16 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "vector", above: float | None = 0.0) -> DataFrame:
    """(query, key, score, place): the ``k`` vectors of greatest cosine ``above`` a bound for each of a stated set of queries.

    ``queries`` (query, vector) go to the tasks QUERY_BYTES at a time; each task
    takes matrix products and keeps its own best ``k`` of each query before
    anything is shuffled.  Null vectors, those of length 0 and those of another
    number of dimensions than the query's have no cosine.
    """
    own = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    asked = written(queries.select("query", "vector"), "queries")
    schema = f"query {asked.schema['query'].dataType.simpleString()}, key {own.schema['key'].dataType.simpleString()}, score double"
    size = asked.agg(F.sum(F.coalesce(F.size("vector"), F.lit(0)) * 8 + 32)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for n in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)).toArrow()

        def compare(batches: Iterator[pa.RecordBatch], block: pa.Table = block) -> Iterator[pa.RecordBatch]:
            yield from closest(block, batches, k, above).to_batches()

        one = best(own.mapInArrow(compare, schema), k)
        out = one if out is None else out.unionByName(one)
    return out


def best(scored: DataFrame, k: int, by: str = "query") -> DataFrame:
    """The ``k`` best rows of each query, ties by key; Spark keeps k rows a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def fuse(lists: list[DataFrame], k: int = RRF) -> DataFrame:
    """(query, key, score): the sum of 1 / (60 + place) over ranked lists (query, key, place)."""
    rows = lists[0].select("query", "key", "place")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query", "key", "place"))
    return rows.groupBy("query", "key").agg(F.sum(1.0 / (F.col("place") + k)).alias("score"))


def shown_scores(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(query, key, shown): what a reader is told of a fused hit, the mean of the likenesses (0 to 1) by the engines that found it.

    Keyword scores count from 0 on; cosines are moved from -1 .. 1 to 0 .. 1.
    """
    told = keyword.select("query", "key", F.greatest("score", F.lit(0.0)).alias("s"))
    told = told.unionByName(vector.select("query", "key", F.greatest((F.col("score") + 1) / 2, F.lit(0.0)).alias("s")))
    return told.groupBy("query", "key").agg(F.avg("s").alias("shown"))


def rerank_by_coverage(hits: DataFrame, asked: Column, text: Column, weight: float = RERANK) -> DataFrame:
    """Ranked ``hits`` (query, place, ...) with a new score: coverage of the query's tokens mixed with the old place."""
    query, own = cover_tokens(asked), cover_tokens(text)
    covered = F.coalesce(F.try_divide(F.size(F.array_intersect(query, own)), F.size(query)), F.lit(0.0))
    n = F.count(F.lit(1)).over(Window.partitionBy("query"))
    return hits.withColumn("score", F.when(F.size(query) > 0, weight * covered).otherwise(0.0) + (1 - weight) * (1 - (F.col("place") - 1) / n))


def with_evidence(hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hits with a score of ``threshold`` or more; one without a score passes."""
    return hits.where(F.col("score").isNull() | (F.col("score") >= threshold))


def retrieve(docs: DataFrame, vectors: DataFrame | None, queries: DataFrame, asked: DataFrame | None, k: int, mode: str = "hybrid", per_list: int = 8) -> DataFrame:
    """(query, key, score, place) by ``keyword`` (TF-IDF), ``vector`` (idf-weighed cosine of hashed vectors) or ``hybrid`` (both, fused by rank)."""
    from .vectors import search

    lists = []
    if mode in ("keyword", "hybrid"):
        lists.append(best(tfidf(docs, queries), per_list if mode == "hybrid" else k))
    if mode in ("vector", "hybrid"):
        lists.append(search(vectors, asked, per_list if mode == "hybrid" else k))
    if not lists:
        raise ValueError(f"no mode {mode}")
    return best(fuse(lists), k) if mode == "hybrid" else lists[0]


def smart_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, source: str, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """A pool of four times ``k`` hits, twelve at least, reranked by coverage, spread over sources, without those below the threshold.

    ``docs`` (key, text, ``source``), ``queries`` (query, text) already rewritten.
    """
    pool = retrieve(docs.select("key", "text"), vectors, queries, asked, max(4 * k, 12), per_list=max(4 * k, 12))
    # Some dozen hits for each query from here on.
    placed = written(pool, "pool").join(docs, "key").join(F.broadcast(queries.withColumnRenamed("text", "__asked")), "query")
    ranked = rerank_by_coverage(placed, F.col("__asked"), F.col("text"))
    return with_evidence(diversify(ranked.drop("place"), source, k), threshold).drop("__asked")


def best_of(lists: list[DataFrame], key: str = "key") -> DataFrame:
    """(query, key, score, engines): the best score of each hit over some lists (query, key, score, engine), and all engines that found it."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("query", key).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("engine")).alias("engines"))


def expanded(text: Column, terms: dict[str, list[str]]) -> Column:
    """Translations of the terms in a text, longest terms first, each taken out before shorter ones are looked for."""
    out, left = F.array().cast("array<string>"), text
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.concat(out, F.when(left.contains(term), F.array(*[F.lit(t) for t in terms[term]])).otherwise(F.array().cast("array<string>")))
        left = F.regexp_replace(left, F.lit(term), F.lit("\u0000"))
    return F.array_distinct(out)


def recall_twice(catalog: DataFrame, questions: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """recall_tables() for each question and for its translated terms; a table's better score counts."""
    second = questions.select("query", F.array_join(expanded(F.col("text"), terms), " ").alias("text")).where("text <> ''")
    named = lambda df, e: recall_tables(catalog, df).select("query", "key", "score", F.lit(e).alias("engine"))
    return best_of([named(questions, "words"), named(second, "terms")])


def memory_scores(notes: DataFrame, query: Column) -> Column:
    """Score of a note (text, importance, uses) for a question: ten times the coverage, a little for importance and use; 0 without a hit."""
    asked, own = F.array_distinct(tokens(query)), tokens(notes["text"])
    hit = F.size(F.array_intersect(asked, own))
    extra = F.least(notes["importance"], F.lit(5)) * 0.2 + F.least(notes["uses"], F.lit(5)) * 0.05
    return F.when(F.size(asked) == 0, notes["importance"].cast("double")).when(hit == 0, 0.0).otherwise(hit / F.size(asked) * 10 + extra)


def recall_experience(experiences: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(query, key, score, place): past questions (key, text, hits) that share most tokens with a question, a little for their hits."""
    have = experiences.select("key", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    asked = questions.select("query", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("__q"))
    met = have.join(asked, "token").groupBy("query", "key").agg(F.count(F.lit(1)).alias("__o")).join(sizes, "query").join(experiences.select("key", "hits"), "key")
    return best(met.select("query", "key", (F.col("__o") / F.col("__q") + 0.05 * F.col("hits")).alias("score")), k)


def diversify(hits: DataFrame, source: str, k: int, most: int | None = None) -> DataFrame:
    """The ``k`` best hits of each query, with at most ``most`` (half of k, rounded up) of one source."""
    most = most or (k + 1) // 2
    own = F.row_number().over(Window.partitionBy("query", source).orderBy(F.desc("score"), "key"))
    return best(hits.withColumn("__own", own).where(F.col("__own") <= most).drop("__own"), k)


def recall_tables(catalog: DataFrame, questions: DataFrame, least: float = 1.5, covered: float = 0.5) -> DataFrame:
    """(query, key, score, matched) of catalog rows (key, text) whose tokens a question shares.

    A token counts ln((N + 1) / (df + 0.5)); rows with a score of 1.5 or half of
    the question's tokens stay.
    """
    n = catalog.agg(F.count(F.lit(1)).alias("__n"))  # one row
    asked = questions.select("query", F.explode(F.array_distinct(tokens("text"))).alias("token")).where("query is not null").distinct()
    asked = written(asked, "asked")
    # Rows with the same asked tokens are one kind, and so are questions with the same known ones: kinds are compared, not rows.
    have = catalog.select("key", F.explode(F.array_distinct(tokens("text"))).alias("token")).join(asked.select("token").distinct(), "token")
    rows = written(have.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("held")), "rows")
    kinds = written(rows.groupBy("held").agg(F.count(F.lit(1)).alias("__rows")), "kinds")
    df = kinds.select(F.explode("held").alias("token"), "__rows").groupBy("token").agg(F.sum("__rows").alias("df"))
    idf = written(df.crossJoin(F.broadcast(n)).select("token", F.log((F.col("__n") + 1) / (F.col("df") + 0.5)).alias("idf")), "idf")
    sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("__asked"))
    wants = written(asked.join(idf.select("token"), "token").groupBy("query").agg(F.array_sort(F.collect_set("token")).alias("wants")).join(sizes, "query"), "wants")
    of = ["wants", "__asked"]
    met = kinds.select("held", F.explode("held").alias("token")).join(wants.select(*of).distinct().withColumn("token", F.explode("wants")), "token").join(idf, "token")
    found = met.groupBy("held", *of).agg(F.sum("idf").alias("score"), F.count(F.lit(1)).alias("matched"))
    kept = found.where((F.col("score") >= least) | (F.col("matched") >= covered * F.col("__asked")))
    hits = written(kept.join(wants, of).select("query", "held", "score", "matched"), "hits")
    # A small table of rows may give many hits, so it is spread first.
    spread = rows.repartition(max(1, int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.join(hits, "held").select("query", "key", "score", "matched")
