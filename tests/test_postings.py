"""The text index against the unindexed scores."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import postings, retrieval


def scores(df):
    """Sorted scores of each query: documents of equal scores may stand for one another."""
    out = {}
    for r in df.collect():
        out.setdefault(r.query, []).append(round(r.score, 9))
    return {q: sorted(s) for q, s in out.items()}


@pytest.mark.parametrize("k", [1, 5])
def test_index_equals_tfidf_and_reads_less(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query"), "text")
    index, read = postings.build(docs), []
    assert scores(index.search(asked, k, read=read)) == scores(retrieval.best(retrieval.tfidf(docs, asked), k))
    own, every = (x.agg(F.sum("n")).first()[0] for x in read)
    assert 0 < own < (0.5 if k == 1 else 0.9) * every


def test_odd_texts_and_a_common_token(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(["all", *rng.choices(words, k=rng.randrange(0, 12))])) for k in range(400)] + [(1000, None), (1001, ""), (1002, "报销流程 abc"), *((k, "same words here") for k in range(2000, 2040))]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "all"), (2, "w1 w2 w59"), (3, "same words here"), (4, "nothing known"), (5, None), (6, ""), (7, "报销"), (8, "all all w3"), (9, "the w7 w7 w8 w9 same")], "query int, text string")
    postings.build(docs, str(tmp_path / "index"))
    index = postings.TextIndex(spark, str(tmp_path / "index"))
    for k in (1, 3, 50, 1000):
        assert scores(index.search(asked, k)) == scores(retrieval.best(retrieval.tfidf(docs, asked), k))
    assert index.search(asked.limit(0), 3).collect() == []
    assert index.keys.groupBy("block").count().where(f"count > {postings.BLOCK}").count() == 0
    held = index.postings.select("token", F.size("held").alias("s"), "n").where("s <> n").count()
    assert held == 0 and index.terms.where("token = 'same'").first().df == 40


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "key long, text string")
    index = postings.build(none.unionByName(spark.createDataFrame([(1, None)], "key long, text string")))
    assert index.search(spark.createDataFrame([(1, "a")], "query int, text string"), 2).collect() == []
