"""The knowledge folder: walk, chunks, and an index that follows the folder."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodeframe.operators import lineage, measures, retrieval, vectors
from lodeframe.sources import knowledge


def put(folder, name, text, encoding="utf-8"):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def state(index):
    files = sorted((r.source, [(c.ref, c.chunk, [tuple(t) for t in c.terms]) for c in r.chunks]) for r in index.files.read().collect())
    return files, sorted(map(tuple, index.terms.read().collect()))


def test_walk_and_chunks(spark, tmp_path):
    put(tmp_path, "a.md", "# 报销流程\n\n第一条。\n## 发票\n" + "内容。" * 400)
    put(tmp_path, "deep/er/b.TXT", "出差标准", "gb18030")
    put(tmp_path, ".hidden/c.md", "no")
    put(tmp_path, "deep/.d.md", "no")
    put(tmp_path, "e.pdf", "no")
    put(tmp_path, "empty.txt", "")
    with open(tmp_path / "huge.txt", "wb") as f:
        f.truncate(knowledge.LARGEST + 1)
    assert sorted(r.source for r in knowledge.walk(spark, str(tmp_path)).collect()) == ["a.md", "deep/er/b.TXT"]
    rows = knowledge.knowledge(spark, f"file://{tmp_path}").collect()
    assert {r.source for r in rows} == {"a.md", "deep/er/b.TXT"} and all(r.page is None and len(r.updated) == 10 for r in rows)
    assert [r.chunk for r in rows if r.source != "a.md"] == ["出差标准"] and [r.ref for r in rows if r.source == "a.md"][:2] == ["a.md#0", "a.md#1"]
    words = knowledge.routing_keywords(spark.createDataFrame([("x/政策 手册.md", "# 报销流程\n text\n## 发票 \n### no"), ("y.txt", None)], "source string, text string"))
    assert sorted((r.source, r.keyword) for r in words.collect()) == [("x/政策 手册.md", "发票"), ("x/政策 手册.md", "报销流程"), ("x/政策 手册.md", "政策 手册"), ("y.txt", "y")]


def test_refresh_equals_rebuild(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    for k in range(6):
        put(folder, f"f{k}.md", f"common words file{k}\n" + f"only{k} " * 40)
    index = knowledge.KnowledgeIndex(spark, str(folder), str(tmp_path / "index"), 4)
    assert index.refresh() == {"written": 6, "removed": 0} and index.refresh() == {"written": 0, "removed": 0}
    put(folder, "f1.md", "common other text now")
    put(folder, "sub/new.txt", "only0 fresh")
    (folder / "f2.md").unlink()
    # As long and as old as before: a refresh that read this file would find the change.
    was = os.stat(folder / "f3.md")
    put(folder, "f3.md", (folder / "f3.md").read_text().replace("file3", "FILE9"))
    os.utime(folder / "f3.md", ns=(was.st_atime_ns, was.st_mtime_ns))
    assert index.refresh() == {"written": 2, "removed": 1}
    assert "file9" not in dict(index.terms.read().collect())
    put(folder, "f3.md", (folder / "f3.md").read_text().replace("FILE9", "file3"))
    os.utime(folder / "f3.md", ns=(was.st_atime_ns, was.st_mtime_ns))
    again = knowledge.KnowledgeIndex(spark, str(folder), str(tmp_path / "again"), 4)
    again.refresh()
    assert state(index) == state(again)
    asked = spark.createDataFrame([(1, "only0 fresh"), (2, "common"), (3, "nothing")], "query int, text string")
    docs = knowledge.knowledge(spark, str(folder)).select(F.col("ref").alias("key"), F.col("chunk").alias("text"))
    plain = retrieval.best(retrieval.tfidf(docs, asked), 3)
    rounded = lambda df: sorted((r.query, r.place, r.key, round(r.score, 9)) for r in df.collect())
    assert rounded(index.search(asked, 3)) == rounded(plain)
    # A refresh that ended between its two tables.
    put(folder, "f4.md", "common late")
    monkeypatch.setattr(index.terms, "apply", lambda *a, **k: None)
    index.refresh()
    monkeypatch.undo()
    index.refresh()
    last = knowledge.KnowledgeIndex(spark, str(folder), str(tmp_path / "last"), 4)
    last.refresh()
    assert state(index) == state(last)


def test_smart_search_and_two_passes(spark):
    docs = spark.createDataFrame([("a#0", "员工报销流程需要提交发票", "a"), ("a#1", "报销流程 说明", "a"), ("b#0", "咖啡机的水箱需要定期清洗", "b"), ("c#0", None, "c")], "key string, text string, source string")
    asked = spark.createDataFrame([(1, "报销流程"), (2, "怎么清洗水箱")], "query int, text string")
    own, theirs = vectors.embed(docs), vectors.embed(asked.withColumnRenamed("query", "key")).withColumnRenamed("key", "query")
    hits = retrieval.smart_search(docs.select("key", "text", "source"), own, asked, theirs, "source", 2)
    got = {}
    for r in hits.orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.key)
    assert got[1][0].startswith("a#") and got[2][0] == "b#0" and all(len(v) <= 2 for v in got.values())
    catalog = spark.createDataFrame([(1, "spread_table credit spread"), (2, "coffee sales"), (3, "其他 表")], "key int, text string")
    twice = retrieval.recall_twice(catalog, spark.createDataFrame([(1, "信用利差变化"), (2, "coffee")], "query int, text string"), {"信用利差": ["credit spread"]})
    assert {(r.query, r.key): r.engines for r in twice.collect()} == {(1, 1): ["terms"], (2, 2): ["words"]}


def test_samples_are_the_same_however_rows_are_split(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("x"))
    take = lambda df: sorted(r.id for r in measures.sampled(df, ["id"], 150, "x > 2", ["id"]).collect())
    assert take(rows.repartition(3)) == take(rows.repartition(11, "x")) and len(take(rows)) == 150
    assert measures.sampled(rows, ["x"], 5).count() == 100
    try:
        measures.sampled(rows, ["no; drop"])
        raise AssertionError
    except ValueError:
        pass


def test_a_recorded_answer_runs_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        runs.add(1)
        return x

    shown, row = lineage.answered_and_recorded(spark.range(50).select(counted("id").alias("id")), ["id"], 10, "n", "select 13812345678")
    told = row.first()
    assert (told.n_rows, shown.count(), runs.value) == (50, 10, 50) and told.sql == "select 138****5678"
    assert [r.truncated for r in shown.limit(1).collect()] == [True]
    assert lineage.preview(spark.createDataFrame([(2, "王小明"), (1, "李雷")], "k int, customer_name string"), ["k"], 1).collect() == [(1, "李*")]
