"""Steps that have to grow with their input: what they compare and hand on, counted, and results that stay exact at it."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.operators import chunks, postings, retrieval, stats, vectors
from lodeframe.plans import registry
from lodeframe.sources import files
from lodeframe.streaming import masker

registry.load()


def test_recall_compares_kinds_of_rows(spark, monkeypatch):
    """Every question shares a word with every row, yet rows and questions meet by the few sets of asked words."""
    rows = {}
    keep = retrieval.written

    def counting(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(retrieval, "written", counting)
    catalog = spark.createDataFrame([(k, f"brand {k % 3} own{k}") for k in range(600)] + [(600, None), (600, "brand")], "key int, text string")
    asked = spark.createDataFrame([(q, f"brand {q % 3} word{q} more{q}") for q in range(200)] + [(200, "unknown"), (201, None)], "query int, text string")
    found = {(r.query, r.key): (round(r.score, 9), r.matched) for r in retrieval.recall_tables(catalog, asked).collect()}
    assert set(found) == {(q, k) for q in range(200) for k in range(600) if q % 3 == k % 3} and {m for _, m in found.values()} == {2}
    assert rows["kinds"] == 4 and rows["hits"] == 200


def test_three_votes_that_sql_states(spark, smallest, duck):
    """All three count: the votes of outlier_votes include the one by the median, and the report of outliers goes by all."""
    votes = registry.QUERIES["outlier_votes"](spark, smallest)
    assert {"by_z", "by_range", "by_median", "votes"} < set(votes.columns)
    assert votes.count() == duck.execute("SELECT count(value) FROM events").fetchone()[0]
    assert votes.where("votes <> cast(by_z as int) + cast(by_range as int) + cast(by_median as int)").count() == 0
    assert votes.agg({"votes": "max"}).first()[0] == 3
    assert {r.votes for r in registry.QUERIES["anomalous_events"](spark, smallest).collect()} == {3}


def _vectors(spark, n, d=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=d).tolist()) for k in range(n)]
    # Vectors without direction, of other dimensions, and copies.
    return rows, spark.createDataFrame(rows + [(n, [0.0] * d), (n + 1, [1.0]), (n + 2, None), (n + 3, rows[0][1])], "key int, vector array<double>")


def test_index_answers_exactly(spark):
    """With lists that a plain search opens too few of, exactly() finds what a comparison with all finds."""
    rows, own = _vectors(spark, 400)
    index = vectors.InvertedLists(own, exact_below=0, target=0.1)
    asked = own.where("key % 9 = 0").withColumnRenamed("key", "query")
    told = lambda df: {(r.query, r.key, r.place): round(r.score, 9) for r in df.collect()}
    plain = told(retrieval.nearest(own, asked, 5))
    assert told(index.search(asked, 5)) != plain
    assert told(index.exactly(asked, 5)) == plain


def test_idf_search_shuffles_entries_not_pairs(spark):
    """Products of each pair and dimension are no rows, and the scores are those of plain sums."""
    rows, own = _vectors(spark, 300)
    entries = vectors.sparse(own, "key", "vector").where("value > 0.1")
    asked = entries.where("key % 10 = 0").withColumnRenamed("key", "query")
    found = vectors.search(entries, asked, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sum((w" not in plan
    x = np.array([[v if v > 0.1 else 0 for v in (rows[k % 303] if k < 300 else rows[0])[1]] for k in [*range(300), 303]])
    have = np.array([*range(300), 303])
    # The one of another dimension counts for the frequencies.
    df = (x > 0).sum(0) + np.eye(8)[0]
    n = (x > 0).any(1).sum() + 1
    w = x * np.log((n + 1) / (df + 1))
    w = w / np.maximum(np.sqrt((w * w).sum(1)), 1e-12)[:, None]
    got = {}
    for r in found.orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.key, round(r.score, 9)))
    for q in range(10, 300, 10):
        score = np.round(w @ w[q], 9)
        order = sorted((-s, k) for s, k in zip(score.tolist(), have.tolist()) if s > 0 and k != 301)[:6]
        assert [s for _, s in got[q]] == [-s for s, _ in order][:4]
    assert vectors.search(entries.limit(0), asked, 4).collect() == []


def test_clusters_are_dealt_out(spark):
    """A table of one split is clustered by several tasks."""
    rows = spark.range(6000).coalesce(1).selectExpr("cast(id % 50 as double) as a", "cast(id % 7 as double) as b")
    placed, _, _ = stats.clusters(rows, ["a", "b"], 3)
    assert placed.count() == 6000 and placed.rdd.getNumPartitions() > 1


def test_chunks_are_given_out_in_parts():
    """However many texts a batch has, their chunks aren't held at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([None, "", *["word " * 20_000] * 38])], ["doc", "text"])
    made = list(chunks._chunked(iter([batch]), 500, 60))
    assert max(sum(map(len, b.column("chunk").to_pylist())) for b in made) < chunks.SENT + 200_000 and len(made) > 2
    assert [d for b in made for d, i in zip(b.column("doc").to_pylist(), b.column("chunk_index").to_pylist()) if i == 0] == list(range(2, 40))
    assert [c for b in made for c in b.column("chunk").to_pylist()] == [c.strip() for c in chunks.cut(("word " * 20_000).strip())] * 38


def test_chunk_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", "one\r\ntwo", 2.5), (2, "b", None, None), (3, None, "three " * 200, 1.0)], "k long, source string, text string, x double")
    rows = sorted(chunks.chunks(docs, "source", "text").collect(), key=lambda r: (r.k, r.chunk_index))
    assert [(r.k, r.source, r.x, r.chunk_index, r.ref) for r in rows[:2]] == [(1, "a", 2.5, 0, "a#0"), (3, None, 1.0, 0, rows[1].ref)] and len(rows) == 4
    assert rows[0].chunk == "one\ntwo"


def _plain_end(line, inside, separator):
    """Whether a quoted cell is open at the end of a line, a character at a time."""
    at, start = 0, not inside
    while at < len(line):
        if inside:
            if line[at] == '"' and line[at + 1 : at + 2] == '"':
                at += 1
            elif line[at] == '"':
                inside = False
        elif line.startswith(separator, at):
            start = True
            at += len(separator)
            continue
        elif start and line[at] == '"':
            inside, start = True, False
        elif line[at] != " ":
            start = False
        at += 1
    return inside


def test_encodings_are_tried_in_turn(spark, monkeypatch):
    """Lines in the first encoding of the ladder are decoded by that alone; a later one is found where an earlier fails."""
    rng = random.Random(4)
    for _ in range(3000):
        line = "".join(rng.choice('"", ab|') for _ in range(rng.randrange(12)))
        for separator in (",", "|"):
            for inside in (False, True):
                assert files.ends_inside(line, inside, separator) == _plain_end(line, inside, separator), (line, inside)
    tried, keep = [], files._bad
    monkeypatch.setattr(files, "partial", lambda f, **given: tried.append(given.get("encoding")) or (lambda batches, e=given["encoding"]: keep(batches, e)))
    lines = lambda name, text: spark.createDataFrame([(bytearray(text.encode(name)),), (bytearray(b"plain"),), (None,)], "line binary")
    assert files.encoding_of(lines("utf-8", "中文 text")) == "utf-8" and tried == ["utf-8"]
    assert files.encoding_of(lines("gb18030", "中文")) == "gb18030"
    assert files.encoding_of(lines("latin-1", "caf\xe9\xff")) == "latin-1"


def test_stream_state_comes_with_the_rows():
    """A batch of a stream is one read and one write of its state, whatever it has to keep."""

    class State:
        exists, hasTimedOut, calls, get = False, False, 0, None

        def update(self, new):
            self.exists, self.get, self.calls = True, new, self.calls + 1

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, silent):
            self.silent = silent

    state = State()
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["seq", "chunk", "last"])])
    assert list(masker._in_turn((7,), frame([(k, f"<{k}>", k == 9) for k in range(1, 10)]), state, 50)) == []
    assert state.calls == 1 and state.silent == 50 and len(state.get[3]) == 9
    (out,) = masker._in_turn((7,), frame([(0, "<0>", False), (3, "again", False)]), state, 50)
    assert out.values.tolist() == [[7, 0, "".join(f"<{k}>" for k in range(10))]] and not state.exists and state.calls == 1


def test_tfidf_shuffles_texts_not_tokens(spark, monkeypatch):
    """The corpus is counted after one shuffle of its texts by key."""
    plans, keep = {}, retrieval.written

    def telling(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(retrieval, "written", telling)
    docs = spark.createDataFrame([(1, "a b b"), (2, None), (3, "b c"), (3, "c d")], "key int, text string")
    asked = spark.createDataFrame([(1, "b"), (2, "zz")], "query int, text string")
    got = {r.key for r in retrieval.tfidf(docs, asked).collect()}
    assert got == {1, 3} and plans["counts"].count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(key" in plans["counts"] and "token" not in plans["counts"].split("Exchange hashpartitioning")[1].split("\n")[0]


def test_index_hands_on_spans_not_pairs(spark, monkeypatch):
    """Counts are a row for each span, postings one for each token of a span; over many spans the best are those of all, ties by key."""
    rng, rows, keep = random.Random(8), {}, postings.written

    def counting(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(postings, "written", counting)
    monkeypatch.setattr(postings, "SPAN", 6000)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(400)] + ["same words 报销 here"] * 50 + [None, "", "İx K9_ 报销流程"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    asked = spark.createDataFrame([(1, "same words here"), (2, "w1 w2 w2 w29"), (3, "报销"), (4, "k9_ ix i x"), (5, "no")], "query int, text string")
    index = postings.build(docs)
    spans = index.postings.select("span").distinct().count()
    assert 3 < spans and rows["counts"] <= spans + 2
    pairs, held = index.postings.agg(F.sum("n"), F.count("token")).first()
    assert held <= spans * index.terms.count() and pairs > 2 * held
    told = lambda df: sorted((r.query, round(r.score, 9)) for r in df.collect())
    found = index.search(asked, 5)
    assert told(found) == told(retrieval.best(retrieval.tfidf(docs, asked), 5)) and {r.query for r in found.collect()} == {1, 2, 3, 4}
    assert [r.key for r in found.where("query = 1").orderBy("place").collect()] == [400, 401, 402, 403, 404]
