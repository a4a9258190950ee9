"""URL filter and preference formatting against SQL and on odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.llm import chat, urlfilter
from lodeframe.llm.queries import op4_preference_pairs, op8_url_filter
from lodeframe.llm.sql import ORACLES


def test_queries_equal_sql(spark, smallest, rows_of, duck_rows):
    assert rows_of(op4_preference_pairs(spark, smallest)) == duck_rows(ORACLES["op4_preference_pairs"])
    assert rows_of(op8_url_filter(spark, smallest)) == duck_rows(ORACLES["op8_url_filter"])


def test_urls_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.NET/en/a?x#y", "www.example.net", "/en/a", "example.net/en/", "allow"),
        2: ("http://example.net/enx", "example.net", "/enx", "net/", "block"),
        3: ("http://example.net", "example.net", "", None, None),
        4: ("ftp://a.org?q=/fr/", "a.org", "", None, None),
        5: ("ftp://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
        6: ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
        7: ("x://b.example.com/de/?", "b.example.com", "/de/", "example.com/de/", "block"),
        8: ("no scheme", "", "", None, None),
        9: (None, "", "", None, None),
        10: ("://net/", "net", "/", "net/", "block"),
        11: ("http://É.NET/a", "É.net", "/a", "net/", "block"),
    }
    pages = spark.createDataFrame([(k, v[0], "junk") for k, v in urls.items()], "page_id long, url string, bad string")
    outcomes = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "page_id long, bad int")
    got = {r.page_id: r for r in urlfilter.judge(pages, outcomes).collect()}
    assert set(got) == set(urls)
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(f"bad{k}.example.org", 1) for k in range(20) for _ in range(5)] + [(f"h{k}.fine.com", 0) for k in range(40) for _ in range(5)] + [("new.example.org", None), ("new.fine.com", None)]
    got = {r.host: r for r in urlfilter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["new.example.org"].bad_mean > 0.5 > got["new.fine.com"].bad_mean
    assert all(0 <= r.bad_mean <= 1 and r.bad_bound <= r.bad_mean for r in got.values())


def test_method_gives_both_verdicts(spark, smallest):
    """Without a rule a host is blocked for its bad pages alone, and a new host of a bad domain with it."""
    hosts = [f"bad{k}.worse.co.uk" for k in range(20)] + [f"h{k}.fine.com" for k in range(60)] + ["new.worse.co.uk", "other.co.uk"]
    pages = [(n, f"http://{h}/{k}", int(h.startswith("bad"))) for n, (h, k) in enumerate((h, k) for h in hosts for k in range(5))]
    frame = spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")
    outcomes = spark.createDataFrame([(p[0], p[2]) for p in pages[:400]], "page_id long, bad int")
    got = {r.host: r.verdict for r in urlfilter.judge(frame, outcomes, rules=[]).collect()}
    assert all(v == ("block" if "worse" in h else "allow") for h, v in got.items() if h != "other.co.uk")
    real = [r.verdict for r in op8_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").collect()]
    assert set(real) == {"allow", "block"}


def test_registered_domains(spark):
    domain, suffix = urlfilter.registered(F.col("h"))
    rows = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "")], "h string").select(domain, suffix).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


def test_ports_users_and_addresses(spark):
    domain, suffix = urlfilter.registered(F.col("h"))
    want = {
        "a.example.com:8080": ("example.com", "com"), "a.example.com.": ("example.com", "com"), "me:x@a.b.co.uk:1": ("b.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "[address]"), "10.0.0.1:80": ("10.0.0.1", "[address]"),
        "[::1]:443": ("[::1]", "[address]"), "1.2.3.com": ("3.com", "com"), ":80": ("", ""), "x:": ("x", "x"), "..": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in rows} == want
    # A host with a port shares its domain's reputation, and an address that of addresses alone.
    hosts = [(f"h{k}.worse.com:8{k:03}", 1) for k in range(30) for _ in range(4)] + [(f"10.0.0.{k}", 0) for k in range(30) for _ in range(4)] + [("new.worse.com", None), ("new.worse.com:99", None), ("10.9.9.9:1", None), ("9.9", None)]
    got = {r.host: r.bad_mean for r in urlfilter.reputations(spark.createDataFrame(hosts, "host string, bad int")).collect()}
    assert got["new.worse.com"] == got["new.worse.com:99"] > 0.5 > got["10.9.9.9:1"] and got["10.9.9.9:1"] < got["9.9"]


def test_query_states_ports_as_its_sql(spark, tmp_path, rows_of):
    import duckdb

    urls = [f"http://{h}/p" for h in ("a.b.com:80", "a.b.com", "u@a.b.com.", "1.2.3.4", "1.2.3.4:5", "[::1]:9", "co.uk:1", "x.y.co.uk", "")] * 4
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, k % 3 % 2, 0) for k in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(ORACLES["op8_url_filter"]).fetchall()))
    columns = [d[0] for d in con.execute(ORACLES["op8_url_filter"]).description]
    assert sorted(repr(tuple(r)) for r in op8_url_filter(spark, str(tmp_path)).select(columns).collect()) == want


def test_no_pages_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert urlfilter.judge(pages.limit(0), none).collect() == []
    assert urlfilter.judge(pages, none).collect()[0].verdict in ("allow", "block")


def test_common_prefix_and_masks(spark):
    turn = "array<struct<role:string,text:string>>"
    user, yes, no = ("user", "héllo"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [user, yes], [user, no]), (2, [user, yes], [user, yes]), (3, [user, yes], [user]), (4, None, [user]), (5, [], None), (6, [user, yes, user, no], [user, yes, no])]
    got = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame([(*r, "x") for r in rows], f"pair_id long, chosen {turn}, rejected {turn}, prompt string")).collect()}
    assert [got[k].prefix_turns for k in range(1, 7)] == [1, 2, 1, 0, 0, 2]
    assert got[1].prompt == "<|user|>\nhéllo<|end|>\n" and got[1].chosen == "<|assistant|>\nyes<|end|>\n"
    assert (got[3].rejected, got[5].prompt, got[5].chosen) == ("", "", "")
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[s.start : s.end] in ("yes<|end|>", "no<|end|>") for s in spans)
            assert len(spans) == text.count("<|assistant|>")


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, None, None), (1, 1, None, None), (None, 1, "user", "x"), (2, None, "user", "q"), (3, 1, "user", ""), (3, 1, "assistant", "")]
    talks = chat.conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in talks.collect()}
    assert got == {1: [("unknown", ""), ("unknown", ""), ("assistant", "b")], 2: [("user", "q")], 3: [("assistant", ""), ("user", "")]}
    pairs = chat.format_pairs(chat.next_as_rejected(talks)).collect()
    assert sorted(r.pair_id for r in pairs) == [1, 2, 3]
    assert chat.format_pairs(chat.next_as_rejected(talks.limit(0))).collect() == []
