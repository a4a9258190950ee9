from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import masking, numbers, text
from lodeframe.operators import chunks, compare, forecast, isolation, lineage, measures, retrieval, stats, vectors
from lodeframe.sources import files
from lodeframe.streaming import keyed, masker, slots, sync


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


@pytest.mark.parametrize(
    ("cell", "loose", "strict"),
    [("$ 100.00", 100, 100), ("1,234.5", 1234.5, 1234.5), ("23%", 23, 23), ("(6.5)", -6.5, -6.5), ("-6.5 ( 6.5 )", -6.5, -6.5), ("1 234.5", 1234.5, 1234.5), ("(-6.5)", 6.5, -6.5),
     ("-1,234", None, -1234), ("1e5", None, None), ("+5", None, None), (".5", None, None), ("9" * 41, None, None), ("", None, None), (None, None, None), ("12 34", 1234, 1234)],
)
def test_to_number(spark, cell, loose, strict):
    lit = F.lit(cell).cast("string")
    assert one(spark, numbers.to_number(lit)) == loose and one(spark, numbers.to_number(lit, strict=True)) == strict


def test_names():
    assert numbers.normalise_names(["a", "A", None, " x  y ", "a_2"]) == ["a", "A_2", "col3", "x y", "a_2_2"]


def test_masks(spark):
    samples = {"call 13812345678 now": "call 138****5678 now", "me.too@mail.example.org": "m***@mail.example.org", "at 10.20.30.40": "at 10.20.*.*", "plain 12345": "plain 12345", "card 6222021234567890123 end": "card 6222***********0123 end"}
    assert {s: one(spark, masking.mask_text(F.lit(s))) for s in samples} == samples
    frame = spark.createDataFrame([("王小明", "13812345678", 120, None)], "patient_name string, contact_phone string, amount int, email string")
    assert masking.mask(frame).collect()[0] == ("王**", "138****5678", 120, None)
    assert [masking.kind_of(c) for c in ("insurance_type", "month", "ClientName", "客户手机", "client_id")] == [None, None, "name", "phone", "serial"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("报销 Abc"))) == ["abc", "报", "销", "报销"]
    assert one(spark, text.estimate_tokens(F.lit("报销abcd"))) == 3 and one(spark, text.estimate_tokens(F.lit(None))) == 0
    assert one(spark, text.chunk_ref(F.lit("a.pdf"), F.lit(2), F.lit(7))) == "a.pdf#2@p7"


def test_questions_terms_and_units(spark):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "q string")
    asked = {r.q: r.a for r in frame("请问报销流程是什么呢？", "麻烦你帮我看看上月的销售额吧", "谢谢", "show orders").select("q", text.rewritten("q").alias("a")).collect()}
    assert asked == {"请问报销流程是什么呢？": "报销流程是什么", "麻烦你帮我看看上月的销售额吧": "上月的销售额", "谢谢": "谢谢", "show orders": "show orders"}
    terms = {"信用利差": ["credit spread"], "利差": ["spread"], "咖啡": ["coffee", "latte"], "收入": ["income"]}
    found = {r.q: r.t for r in frame("信用利差变化", "咖啡收入和利差", "无").select("q", retrieval.expanded(F.col("q"), terms).alias("t")).collect()}
    assert {q: sorted(t) for q, t in found.items()} == {"信用利差变化": ["credit spread"], "咖啡收入和利差": ["coffee", "income", "latte", "spread"], "无": []}
    rows = spark.createDataFrame([("约 1,234.5 万元", 12345000.0), ("2 亿", 200000000.0), ("涨了 23%", 23.0), ("没有数", 1.0), ("3千", 3000.0)], "t string, truth double")
    told = [tuple(r) for r in rows.select(F.get(compare.numbers_in("t"), F.lit(0)), compare.number_matches("t", "truth")).collect()]
    assert told == [(12345000.0, True), (200000000.0, True), (23.0, True), (None, False), (3000.0, True)]


def test_masked_sentences(spark):
    said = {"身份证号：320101199001011234": "身份证号：32**************34", "客户李雷, 手机13812345678": "客户李*, 手机138****5678", "客户满意度高": "客户满意度高", "姓名：王小明": "姓名：王**",
            "联系地址：北京市朝阳区建国路88号": "联系地址：北京市朝阳区******", "卡 6222021234567 付 ¥1234567890123": "卡 6222*****4567 付 ¥1234567890123"}
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", masking.mask_free_text("s").alias("m")).collect()
    assert {r.s: r.m for r in rows} == said


def test_notes_and_changes(spark):
    old = spark.createDataFrame([("Likes tea.", ["a"], 1, 1)], "text string, tags array<string>, importance int, seen int")
    new = spark.createDataFrame([("likes  TEA", ["b"], 2), ("new", ["c"], 3), ("likes tea!", ["a"], 4)], "text string, tags array<string>, seen int")
    assert sorted(map(tuple, sync.noted(old, new, "text", "tags", "seen").collect())) == [("Likes tea.", ["a", "b"], 3, 4), ("new", ["c"], 1, 3)]
    old = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "z", None)], "k int, a string, b string")
    new = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (4, "n", None)], "k int, a string, b string")
    assert {r.k: r.change for r in sync.changes(old, new, "k", ["a", "b"]).collect()} == {1: "written", 2: "unchanged", 3: "removed", 4: "written"}


def test_repeated_lines(spark):
    def kept(body):
        return spark.createDataFrame([(body,)], "t string").select(text.without_repeated_lines("t")).first()[0]

    assert kept("- first line\nshort\n1. first line\nshort\n\nother line\n  • other  line") == "- first line\nshort\nshort\n\nother line"
    assert kept(None) == "" and kept("") == ""
    lines = [f"line number {k % 3000} of many" for k in range(20_000)]
    began = time.time()
    assert kept("\n".join(lines)) == "\n".join(lines[:3000])
    assert time.time() - began < 20


def test_trimmed_snippets(spark):
    def short(body, asked, limit=20):
        return spark.createDataFrame([(body, asked)], "t string, q string").select(chunks.trimmed(F.col("t"), F.col("q"), limit)).first()[0]

    assert short("  abc  ", "q") == "abc" and short(None, None) == ""
    assert short("无关的话。" * 9 + "报销需要发票。" + "别的内容。" * 9, "报销发票", 13) in ("无关的话。报销需要发票。", "报销需要发票。别的内容。")
    assert short("x" * 15 + "。" + "y" * 30, "z") == "x" * 15 + "。"
    assert short("y" * 50, "z") == "y" * 20 + "…" and len(short("y" * 3 + "。" + "y" * 50, None, 20)) <= 21


def test_profile_and_correlation_with_gaps(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(100, 15, 500)
    rows = [(float(v) if k % 5 else None, float(2 * v + rng.normal(0, 0.1)), 3.0) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "x double, y double, same double")
    got = {r["column"]: r for r in stats.profile(frame, ["x", "y", "same"]).collect()}
    assert got["x"].missing == pytest.approx(0.2) and got["y"].mean == pytest.approx(np.mean([r[1] for r in rows])) and got["same"].skew == 0
    r = {(c.a, c.b): c for c in stats.correlations(frame, ["x", "y", "same"]).collect()}
    assert r["x", "y"].r > 0.8 and r["x", "same"].r == 0 and r["x", "same"].grade == "极弱/无"


def test_outliers_and_clusters(spark):
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(f"行{k}", float(v)) for k, v in enumerate([*rng.normal(100, 5, 300), 500.0])], "label string, v double")
    assert stats.outliers(frame, "v", "label").orderBy(F.desc("z")).first()[:2] == ("行300", 500.0)
    assert stats.outliers(frame.limit(3), "v", "label").count() == 0
    blobs = [(float(a + rng.normal(0, 0.3)), float(b + rng.normal(0, 0.3))) for a, b in ((0, 0), (10, 0), (0, 10)) for _ in range(80)]
    placed, k, silhouette = stats.clusters(spark.createDataFrame(blobs, "a double, b double"), ["a", "b"])
    assert k == 3 and silhouette > 0.7
    assert sum(r["size"] for r in stats.portraits(placed, ["a", "b"]).select("cluster", "size").distinct().collect()) == 240


def test_retrieval(spark):
    docs = spark.createDataFrame([("policy#1", "员工报销流程需要提交发票"), ("policy#2", "出差乘坐飞机经济舱并住宿标准酒店"), ("faq#1", "咖啡机的水箱需要定期清洗"), ("none", None)], "key string, text string")
    asked = spark.createDataFrame([(1, "报销流程是什么"), (2, "飞机经济舱住宿多少钱"), (3, "咖啡机怎么清洗水箱")], "query long, text string")
    top = {r.query: r.key for r in retrieval.best(retrieval.tfidf(docs, asked), 1).collect()}
    assert top == {1: "policy#1", 2: "policy#2", 3: "faq#1"}
    assert {r.key for r in retrieval.recall_tables(docs, asked.where("query = 3")).collect()} >= {"faq#1"}


def plain_path(values, x, rng, depth, most):
    """Path of one value through a tree that is grown on the way; the generator is asked in the order of the grown tree."""
    values = sorted(values)
    if depth < most and len(values) > 1 and values[0] < values[-1]:
        cut = rng.uniform(values[0], values[-1])
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if low and high:
            below, above = plain_path(low, x, rng, depth + 1, most), plain_path(high, x, rng, depth + 1, most)
            return below if x < cut else above
    return depth + float(isolation.expected(len(values)))


def test_forest_equals_plain_trees():
    rng = np.random.default_rng(4)
    for values in ([1.0], [2.0, 2.0, 2.0], rng.normal(0, 1, 40).tolist(), rng.integers(0, 4, 60).astype(float).tolist()):
        asked = [-3.0, 0.0, 1.0, 2.0, 0.37, 9.0]
        trees = [isolation.grown(np.array(values), np.random.default_rng([7, t])) for t in range(5)]
        cuts, lengths = isolation.summed(trees)
        most = int(np.ceil(np.log2(max(len(values), 2))))
        want = [np.mean([plain_path(values, x, np.random.default_rng([7, t]), 0, most) for t in range(5)]) for x in asked]
        assert lengths[np.searchsorted(cuts, asked, "right")] == pytest.approx(want)


def test_forest_votes(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(100, 5, 3000), 500.0, -300.0, 160.0]
    frame = lambda parts: spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "k long, v double").repartition(parts)
    one, two = ({r.k: (r.by_forest, r.votes) for r in stats.outlier_votes(frame(p), "v").collect()} for p in (2, 7))
    assert one == two and len(one) == len(values)
    assert all(one[k] == (True, 3) for k in (3000, 3001, 3002))
    # The median is no outlier to the forest, and the farther from it, the odder.
    found = stats.cumulative(frame(3).where("k >= 0").select(F.lit("v").alias("column"), F.col("v").alias("value")))
    forest = isolation.fit(found, len(values))
    score = {r.v: r.s for r in frame(3).where("k >= 0").select("v", isolation.scores("v", forest, len(values)).alias("s")).collect()}
    assert score[500.0] > score[160.0] > 0.5 > score[sorted(values)[1500]]
    far = np.argsort(np.argsort([abs(v - 100) for v in values]))
    odd = np.argsort(np.argsort([score[v] for v in values]))
    assert np.corrcoef(far, odd)[0, 1] > 0.8
    assert stats.outlier_votes(frame(1).limit(7), "v").count() == 0
    same = spark.createDataFrame([(1.0,)] * 30, "v double")
    assert stats.outlier_votes(same, "v").where("votes > 0").count() == 0


def test_compare(spark):
    a = spark.createDataFrame([(1, 2.50, None), (1, 2.50, None)], "a int, b double, c string")
    b = spark.sql("select 1L as a, cast(2.5 as decimal(10,2)) as b, cast(null as string) as c union all select 1L, 2.5, null")
    assert compare.same(a, b) and not compare.same(a, b.limit(1))


def test_sync(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k long, v string")
    assert {r.k: r.change for r in sync.changes(old, new, "k", ["v"]).collect()} == {1: "removed", 2: "written", 3: "unchanged", 4: "written"}
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k long, v string, at long"
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (2, "d", 3), (5, "e", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        keyed.upsert_stream(spark, stream, root, "k", "at", str(tmp_path / "checkpoint"), 8).awaitTermination()
    got = keyed.KeyedTable(spark, root, "k", schema).read().collect()
    assert {(r.k, r.v) for r in got} == {(1, "a"), (2, "d"), (5, "e")}


def test_keyed_table_touches_its_buckets_alone(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(keyed, "CHANGES", 3)
    schema, rng, want = "k long, v string, at long", random.Random(11), {}
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", schema, 16)
    assert table.read().collect() == []
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    for batch in range(8):
        rows = [(rng.choice([None, *range(40)]) if batch else k, f"{batch}-{n}", n, rng.random() < 0.2 and batch > 0) for n, k in enumerate(range(40 if batch == 0 else 10))]
        before = files()
        touched = table.apply(spark.createDataFrame(rows, f"{schema}, gone boolean"), batch, "at", "gone")
        made = set(files()) - set(before)
        assert len(touched) <= len({r[0] for r in rows}) and {int(p.parent.name.split("=")[1]) for p in made} == set(touched)
        assert all(files()[p] == t for p, t in before.items()) and len(made) <= 2 * len(touched)
        for k, v, at, gone in rows:
            want[k] = (v, at, gone)
        assert {(r.k, r.v, r.at) for r in table.read().collect()} == {(k, v, at) for k, (v, at, gone) in want.items() if not gone}
    seen = files()
    assert table.apply(spark.createDataFrame([(1, "again", 1)], schema), 7) == [] and files() == seen
    keep = spark.createDataFrame([(3,), (4,)], "k long")
    table.prune(keep, 8)
    assert {r.k for r in keyed.KeyedTable(spark, str(tmp_path / "t"), "k", schema).read().collect()} == {k for k in (3, 4) if not want[k][2]}


def test_slots_stay_whole_while_one_is_written(spark, tmp_path):
    own = slots.Slots(spark, str(tmp_path / "s"), "a int")
    assert own.read() == (-1, [])
    for version in range(4):
        own.write([(k,) for k in range(version + 1)], version)
        assert own.read()[0] == version and len(own.read()[1]) == version + 1
    # A write that stopped halfway: the version before is in use.
    for p in (tmp_path / "s" / "slot=1").iterdir():
        p.unlink()
    assert own.read()[0] == 2


def test_tables_are_published_together(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(ValueError):
        slots.published(spark, root)
    version = lambda n: {"a": spark.range(n), "b c": spark.range(2 * n)}
    for n in range(1, 5):
        assert slots.publish(version(n), spark.createDataFrame([(f"v{n}",)], "name string"), root, spark.range(n)) == n - 1
        old = slots.published(spark, root)
        assert [x.count() for x in (old[0]["a"], old[0]["b c"], old[2])] == [n, 2 * n, n] and old[1].first()[0] == f"v{n}"
    assert sorted(p.name for p in (tmp_path / "p").glob("v=*")) == ["v=2", "v=3"]
    # A rebuild that fails before its last write leaves all parts as they were.
    with pytest.raises(Exception, match="boom"):
        slots.publish({"a": spark.range(9), "b c": spark.range(9).select(F.expr("raise_error('boom')"))}, spark.range(1), root)
    assert slots.published(spark, root)[0]["a"].count() == 4


def test_versions_and_signatures(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        assert sync.replace_table(spark.range(n), root) == n
    assert sync.read_table(spark, root).count() == 3 and sorted(p.name for p in (tmp_path / "t").glob("v=*")) == ["v=2", "v=3"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    listed = lambda: spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "length", "modificationTime")
    known = spark.createDataFrame(sync.signature(listed()).collect())
    assert not sync.is_stale(listed(), known)
    (tmp_path / "in" / "b.txt").write_text("y")
    assert sync.is_stale(listed(), known) and sync.is_stale(listed(), known.limit(0))


def test_stream_masker(spark, tmp_path):
    said = "联系人：王小明，电话 13812345678。" + "其他内容，" * 30 + "身份证号：320101199001011234 完"
    whole = spark.createDataFrame([(said,)], "t string").select(masking.mask_free_text("t")).first()[0]
    pieces = [said[k : k + 7] for k in range(0, len(said), 7)]
    schema = "stream long, seq int, chunk string, last boolean"
    for part in range(3):
        rows = [(1, k, c, k == len(pieces) - 1) for k, c in enumerate(pieces) if k * 3 // len(pieces) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = masker.masked_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        with masker.ending_with_data(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.part)
    assert "".join(r.text for r in rows) == whole and len(rows) > 1


def run_masker(spark, folder, batches, silent=masker.SILENT, rounds=1):
    schema = "stream long, seq int, chunk string, last boolean"
    out = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = masker.masked_stream(spark.readStream.schema(schema).parquet(str(folder / "in")), silent)
        with masker.ending_with_data(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start(str(folder / "out")).awaitTermination()
    for r in sorted(spark.read.parquet(str(folder / "out")).collect(), key=lambda r: (r.stream, r.part)):
        out = out or {}
        out[r.stream] = out.get(r.stream, "") + r.text
    return out


def test_pieces_in_any_order(spark, tmp_path):
    """Pieces of several streams, shuffled over three batches, some twice."""
    import random

    rng = random.Random(2)
    said = {1: "联系人：王小明，电话 13812345678。" + "其他内容，" * 30 + "身份证号：320101199001011234 完", 2: "客户李雷, 手机13812345678", 3: ""}
    whole = {r.k: r.m for r in spark.createDataFrame(list(said.items()), "k long, t string").select("k", masking.mask_free_text("t").alias("m")).collect()}
    pieces = [(k, n, t[a : a + 5] or None, a + 5 >= len(t)) for k, t in said.items() for n, a in enumerate(range(0, max(1, len(t)), 5))]
    rng.shuffle(pieces)
    third = len(pieces) // 3
    batches = [pieces[:third] + pieces[:4], pieces[third : 2 * third], pieces[2 * third :]]
    assert run_masker(spark, tmp_path, batches) == {k: t for k, t in whole.items() if t}
    table = masker.masked_stream(spark.createDataFrame(sum(batches, []), "stream long, seq int, chunk string, last boolean"))
    assert {r.stream: r.text for r in table.collect()} == {k: t for k, t in whole.items() if t}


def test_silent_streams_end(spark, tmp_path):
    first = [(1, 0, "手机13812345678，", False), (1, 2, "later", False)]
    got = run_masker(spark, tmp_path, [first, [(2, 0, "x", True)]], silent=1)
    assert got == {1: "手机138****5678，later", 2: "x"}


def test_safe_cuts():
    assert masker.safe_cut("x" * 64) == 0 and masker.safe_cut("x" * 100) == 0 and masker.safe_cut("x" * 9000) == 9000
    held = "a" * 40 + "姓名：" + "王小明" + "b" * 55 + "，"
    assert held[: masker.safe_cut(held)].endswith("，")


def test_chunks(spark):
    rng = np.random.default_rng(1)
    body = "".join("".join(rng.choice(list("甲乙丙丁戊"), rng.integers(1, 90))) + str(rng.choice(["。", "\n", "\n\n", "，", " "])) for _ in range(200))
    made = chunks.cut(body.strip())
    assert all(0 < len(c) <= chunks.SIZE for c in made) and set("".join(made)) == set(body.strip())
    at = 0
    for c in made:  # each chunk is a piece of the text and goes on where, or a little before, the last one ended
        start = body.find(c, max(0, at - chunks.OVERLAP))
        assert 0 <= start <= at
        at = start + len(c)
    assert at == len(body.strip())
    rows = chunks.chunks(spark.createDataFrame([("a.md", body), ("b.md", ""), ("c.md", None)], "source string, text string"), "source", "text").collect()
    assert {r.source for r in rows} == {"a.md"} and rows[0].ref == "a.md#0"
    hits = spark.createDataFrame([(1, 1, "a#0", 0.9, "one"), (1, 2, "b#0", 0.1, "two"), (2, 1, "c#0", 0.05, "three")], "query int, place int, ref string, score double, chunk string")
    context = {r.query: r.context for r in chunks.assembled(hits).collect()}
    assert context == {1: "[a#0 0.900]\none", 2: chunks.NO_EVIDENCE}
    long = "无关的话。" * 200 + "报销需要发票。"
    short = spark.createDataFrame([(long, "报销发票")], "t string, q string").select(chunks.trimmed(F.col("t"), F.col("q"), 50)).first()[0]
    assert len(short) <= 50 and "报销需要发票。" in short


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "报销流程 abc abc"), (2, ""), (3, None)], "key long, text string")
    want: dict[int, float] = {}
    for token in ["abc", "abc", "报销", "销流", "流程"]:
        code = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        want[code % 512] = want.get(code % 512, 0) + (-1 if code >> 40 & 1 else 1)
    want = {d: np.sign(s) * (1 + np.log(abs(s))) for d, s in want.items() if s}
    norm = np.sqrt(sum(v * v for v in want.values()))
    got = {r.dim: r.value for r in vectors.embed(docs).collect()}
    assert got == pytest.approx({d: v / norm for d, v in want.items()})


def recall(own, asked, index, k=5):
    exact = {(r.query, r.key) for r in retrieval.nearest(own, asked, k).collect()}
    found = {(r.query, r.key) for r in index.search(asked, k).collect()}
    return len(exact & found) / len(exact)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_inverted_lists_hold_their_recall(spark, size):
    """Against exact search, on the given vectors; with fewer lists opened than there are."""
    own = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    index = vectors.InvertedLists(own, exact_below=0)
    assert not index.exact and 0 <= index.reach < 1
    assert recall(own, own.where("key % 50 = 0").withColumnRenamed("key", "query"), index) >= 0.9
    assert index.placed.groupBy("key").count().where("count <> 2").count() == 0


def test_lists_of_clusters_and_of_copies(spark):
    """Half of the vectors are one vector; some have no direction."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in (np.ones(8) if k % 2 else rng.normal(0, 1, 8) + 4 * np.eye(8)[k % 8])]) for k in range(1200)] + [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0])]
    own = spark.createDataFrame(rows, "key long, vector array<double>")
    asked = own.where("key % 20 = 0 or key > 4000 or key = 1").withColumnRenamed("key", "query")
    index = vectors.InvertedLists(own, exact_below=0)
    assert recall(own, asked, index) >= 0.9
    copies = [r.key for r in index.search(asked.where("query = 1"), 4).orderBy("place").collect()]
    assert copies == [1, 3, 5, 7]
    assert vectors.InvertedLists(own).exact and recall(own, asked, vectors.InvertedLists(own)) == 1
    assert vectors.InvertedLists(own.limit(0)).search(asked, 5).collect() == []


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{k:03}", [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(300)]
    own = spark.createDataFrame(rows, "key string, vector array<double>").repartition(7)
    asked = own.where("key < 'v040'").withColumnRenamed("key", "query")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = set()
    for q, a in rows[:40]:
        if any(a):
            ranked = sorted((-round(cos(a, b), 9), key) for key, b in rows if any(b) and cos(a, b) > 1e-12)
            want |= {(q, key, place) for place, (_, key) in enumerate(ranked[:6], 1)}
    got = retrieval.nearest(own, asked, 6).withColumn("r", F.round("score", 9))
    from pyspark.sql import Window

    again = got.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("r"), "key")))
    assert {(r.query, r.place) for r in again.collect()} == {(q, p) for q, _, p in want}
    best = {(r.query, r.key): r.score for r in got.collect()}
    lookup = dict(rows)
    assert all(abs(s - cos(lookup[q], lookup[k])) < 1e-9 for (q, k), s in best.items())
    assert {q: sorted(round(s, 9) for (x, _), s in best.items() if x == q) for q, _, _ in want} == {q: sorted(round(cos(lookup[q], lookup[k]), 9) for x, k, _ in want if x == q) for q, _, _ in want}


def test_forecast(spark):
    months = [f"{2015 + m // 12}-{m % 12 + 1:02d}" for m in range(60)]
    rows = [("up", ym, 100.0 + 3 * m + 10 * np.sin(2 * np.pi * (m % 12) / 12)) for m, ym in enumerate(months)] + [("short", ym, 1.0) for ym in months[:11]]
    series = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "s string, ym string, v double")
    made = forecast.forecast(series, ["s"], 30).collect()
    ahead = sorted((r for r in made if r.kind == "future"), key=lambda r: r.ym)
    assert len(ahead) == 24 and ahead[0].ym == "2020-01" and {r.s for r in made} == {"up"}
    for m, r in enumerate(ahead, 60):
        assert r.v == pytest.approx(100 + 3 * m + 10 * np.sin(2 * np.pi * (m % 12) / 12), rel=0.05)
    tried = {r.model: r.rmse for r in made if r.kind == "model"}
    assert set(tried) == set(forecast.MODELS) and ahead[0].model == min(tried, key=tried.get)
    assert [forecast.held_count(n) for n in (12, 17, 24, 80)] == [2, 4, 4, 12]


def test_measures_and_ranks(spark):
    rows = [(k, k % 2, 100.5 + k, float("nan") if k % 3 else 1.0) for k in range(200)]
    frame = spark.createDataFrame(rows, "client_id int, status int, amount double, gap double")
    assert measures.measures(frame) == ["amount", "gap"] or measures.measures(frame) == ["amount"]
    values = [float(v) for v in np.random.default_rng(3).integers(0, 30, 500)]
    ranks = sorted(r.v for r in stats.average_ranks(spark.createDataFrame([(v,) for v in values], "v double").repartition(7), ["v"]).collect())
    ordered = np.sort(values)
    assert ranks == sorted(((np.searchsorted(ordered, v) + 1 + np.searchsorted(ordered, v, "right")) / 2) for v in values)
    q = stats.quantiles(stats.long_form(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]), [0, 0.1, 0.333, 1]).first().q
    assert q == pytest.approx(np.quantile(values, [0, 0.1, 0.333, 1]).tolist())


def test_column_kinds():
    names = {"patient_name": "name", "client_id": "serial", "product_name": None, "ClientName": "name", "id_card_no": "id", "email": "email", "home_address": "address", "dob": "birth", "api_key": None, "token": "secret", "card_no": "card", "手机号": "phone", "o_totalprice": None}
    assert {n: masking.kind_of(n) for n in names} == names


def test_cells_of_each_kind(spark):
    cases = [("name", "John Smith", "J*** S****"), ("name", "王小明", "王**"), ("phone", "138-1234-5678", "138****5678"), ("phone", "123456", "******"), ("id", "AB1234567", "AB1234*4567"), ("address", "北京市朝阳区建国路88号", "北京市朝阳区******"),
             ("serial", "MR20240001", "******0001"), ("birth", "1990-05-17", "1990-05-**"), ("secret", "hunter2", "*******"), ("ip", "10.1.2.3", "10.1.*.*"), ("card", "6222 0212 3456 7890", "6222********7890"), ("email", "me@x.org", "m***@x.org")]
    for kind, value, want in cases:
        assert one(spark, masking.mask_cell(F.lit(value), kind)) == want, kind
    assert one(spark, masking.mask_cell(F.lit("6222021234567890"), "card", strict=True)) == "*" * 16


def test_owners():
    tables = {"a": ["x", "y"], "b": ["y", "z"]}
    assert lineage.owners(tables, ["x"]) == "a" and lineage.owners(tables, ["b.y"]) == "b"
    with pytest.raises(ValueError):
        lineage.owners(tables, ["y"])


def test_files(spark, tmp_path):
    (tmp_path / "客户.csv").write_bytes("编号,名称,消费额\n1,张三,\"1,200\"\n2,李四,$ 30\n3,王五,(4)\n".encode("gb18030"))
    (tmp_path / "指标.tsv").write_text("指标\t数值\na\t1\nb\t2\n")
    (tmp_path / "带标题.csv").write_text("标题\n序号;姓名\n1;甲\n2;乙\n", encoding="utf-8-sig")
    (tmp_path / "无表头.csv").write_text("1,2\n3,4\n")
    (tmp_path / "空.csv").write_text("")
    (tmp_path / "r.json").write_text('{"data": [{"a": 1, "b": {"c": 2}}, {"a": 2}]}')
    assert files.discover(spark, str(tmp_path)).count() == 5  # the empty one is no table
    read = lambda name: files.read(spark, str(tmp_path / name))
    money = read("客户.csv")
    assert money.columns[:3] == ["编号", "名称", "消费额"] and [r["消费额"] for r in money.orderBy("编号").collect()] == [1200, 30, -4]
    assert [tuple(r)[:1] for r in read("指标.tsv").orderBy("指标").collect()] == [("a",), ("b",)]
    titled = read("带标题.csv")
    assert titled.columns[0] == "序号" and titled.count() == 2
    bare = read("无表头.csv")
    assert bare.columns[0] == "col1" and bare.count() == 2
    assert read("空.csv").count() == 0
    assert read("r.json").count() == 2
    with pytest.raises(ValueError):
        read("x.pdf")


def test_files_are_read_by_place_and_by_all_their_lines(spark, tmp_path):
    read = lambda name, data: (tmp_path / name).write_bytes(data) and files.read(spark, str(tmp_path / name))
    late = read("late.csv", "id,name\n1,a\n2,b\n3,张三\n".encode("gb18030"))
    assert [r["name"] for r in late.orderBy("id").collect()] == ["a", "b", "张三"]
    again = read("again.csv", b"k;v\nx;y\nk;v\n\nz;w\n")
    assert sorted(tuple(r) for r in again.collect()) == [("k", "v"), ("x", "y"), ("z", "w")]
    titled = read("titled.csv", "all of it\na,b\n1,2\nall of it,\n".encode())
    assert titled.columns[:2] == ["a", "b"] and titled.count() == 2
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    tables, failed = files.read_folder(spark, str(tmp_path))
    assert len(tables) == 3 and [p.rpartition("/")[2] for p in failed] == ["bad.parquet"]


def test_quoted_cells(spark, tmp_path):
    read = lambda name, data: (tmp_path / name).write_bytes(data.encode()) and files.read(spark, str(tmp_path / name))
    rows = lambda df: sorted(map(tuple, df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).collect()), key=repr)
    ends = read("ends.csv", 'id,say\n1,"two\nlines"\n2,"a ""b"", c"\n3,plain\n')
    assert rows(ends.select("id", "say")) == [("1.0", "two\nlines"), ("2.0", 'a "b", c'), ("3.0", "plain")]
    header = read("header.csv", '"name, full",n\n"Li, Lei",1\n"Han\r\n\r\nMei",2\n')
    assert header.columns[:2] == ["name, full", "n"] and rows(header.select("name, full", "n")) == [("Han\n\nMei", "2.0"), ("Li, Lei", "1.0")]
    inches = read("inches.csv", 'size,what\n5" wide,a\n7 "x" y,b\n,"c\n')
    assert [r[1].strip('"') for r in rows(inches)] == ["a", "b", "c"]
    tall = read("tall.csv", '"a\nb",c\n' + '"1\n2",3\n')
    assert tall.count() == 1 and tall.columns[0] == "a b"


@pytest.mark.parametrize("broadcast", [files.SPLITS_BYTES, -1])
def test_quoted_cells_over_many_splits(spark, tmp_path, monkeypatch, broadcast):
    """Cells longer than a split, and records cut anywhere."""
    import csv
    import random

    monkeypatch.setattr(files, "SPLITS_BYTES", broadcast)
    rng = random.Random(8)
    piece = lambda: "".join(rng.choice(['a"', "b,", "\n", " c", "d;e", "\n\n", '""', "é"]) for _ in range(rng.choice([1, 3, 40])))
    rows = [(f"k{n}", "x" + piece() + "x" if n % 3 else "plain", "y" * 900 + "\n" + "z" * 900 + "\n" + "w" * 1900 if n % 40 == 0 else "s") for n in range(400)]
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\n").writerows([("key", "cell", "long"), *rows])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = files.read_delimited(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, df.collect())) == sorted(rows * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_open_quotes():
    inside = lambda line, state=False: files.ends_inside(line, state, ",")
    assert [inside(x) for x in ("a,b", '"a', '"a"', 'a"', '"a""', '"a""",', '"a", "b', 'x"y,"', '  "q')] == [False, True, False, False, True, False, True, True, True]
    assert [inside(x, True) for x in ("a", 'a"', 'a"",', '"', '","', '"",')] == [True, False, True, False, True, True]


def test_xml_and_json_of_other_shapes(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<!-- <no/> -->\n<list kind="x">\n <item><a>1</a><b>x</b></item>\n <item><a>2</a></item>\n</list>')
    (tmp_path / "b.json").write_text("[1, 2.5, 3]")
    (tmp_path / "c.jsonl").write_text('"x"\n"y"\n')
    (tmp_path / "d.json").write_text('{"data": [1, 2]}')
    read = lambda name: files.read(spark, str(tmp_path / name))
    assert sorted((r.a, r.b) for r in read("a.xml").collect()) == [(1, "x"), (2, None)]
    assert sorted(r["value"] for r in read("b.json").collect()) == [1, 2.5, 3]
    assert sorted(r["value"] for r in read("c.jsonl").collect()) == ["x", "y"]
    assert sorted(r["value"] for r in read("d.json").collect()) == [1, 2]


def test_markdown(spark):
    blocks = spark.createDataFrame([("t1", "| a | b |\n|---|:-:|\n| 1 | 2 | 3 |\n| 4 |"), ("t2", "no table"), ("t3", None)], "id string, body string")
    got = [(r.id, r.row, r.cells) for r in files.markdown_tables(blocks, "id", "body").orderBy("row").collect()]
    assert got == [("t1", 0, ["a", "b"]), ("t1", 1, ["1", "2"]), ("t1", 2, ["4", ""])]
