"""Packing and training shards against plain versions and round trips."""

from __future__ import annotations

import bisect
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeframe.llm import packing, shards
from lodeframe.llm.queries import op5_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    pool = ["Hello", "world,", "über", "naïve", "日本語", "x" * 40, "don't", "3.14", " ", "ﬁ", "İ", "é", "<s>", "\x00", "emoji😀"]
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (5, "twice"), (5, "twice")]
    out += [(10 + k, rng.choice([" ", "\n", "\t  "]).join(rng.choices(pool, k=rng.choice([1, 7, 300, 3000])))) for k in range(20)]
    out.append((99, " ".join(rng.choices(pool, k=60_000))))
    return out


@pytest.fixture(scope="module")
def encoded():
    tokenizer = Tokenizer.from_file(PATH)
    return {doc: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for doc, text in corpus()}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, 7) for d, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)


def test_pieces_give_every_id_once(docs, encoded):
    rows = packing.pack(docs, PATH).collect()
    by_doc: dict = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
        assert r.doc_tokens == len(encoded[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, list(struct.unpack(f"<{r.length}I", r.ids))))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)
    for doc, ids in encoded.items():
        copies = 2 if doc == 5 else 1
        flat = [i for _, piece in sorted(by_doc[doc])[::copies] for i in piece]
        assert flat == ids and len(by_doc[doc]) == copies * (len(ids) // 4096 + (len(ids) % 4096).bit_count())


def test_the_query_reports_the_same_pieces(spark, smallest):
    rows = op5_packing(spark, smallest).collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows[:400]:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part)) and r.doc_tokens == len(ids)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    slots = shards.permute(np.arange(n), n, 11)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert (slots != shards.permute(np.arange(n), n, 12)).any()


def test_shards_round_trip(spark, docs, encoded, tmp_path):
    out = str(tmp_path / "shards")
    rows = shards.write_shards(docs, out, PATH, key=5, shard=64).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 64 and len(r.ids) == 2 * shards.STRIDE for r in rows)
    got: dict = {}
    for r in rows:
        ids = list(struct.unpack(f"<{shards.STRIDE}H", r.ids))
        assert set(ids[r.tokens :]) <= {shards.PAD_ID}
        got.setdefault(r.doc_id, []).append((r.start, ids[: r.tokens]))
    for doc, ids in encoded.items():
        copies = 2 if doc == 5 else 1
        assert [i for _, piece in sorted(got[doc])[::copies] for i in piece] == ids
    some = shards.read_slots(spark, out, 60, 10).collect()
    assert sorted(r.slot for r in some) == list(range(60, min(70, len(rows))))


def test_files_are_read_at_byte_offsets(spark, docs, tmp_path):
    out = tmp_path / "shards"
    rows = {r.slot: r for r in shards.write_shards(docs, str(out), PATH, key=9, shard=32).collect()}
    record = 20 + 2 * shards.STRIDE + 1
    files = sorted(p for p in (out / "shards").glob("*/part-*") if p.stat().st_size)
    assert [p.stat().st_size for p in files[:-1]] == [32 * record] * (len(files) - 1) and len(files) == -(-len(rows) // 32)
    for slot in (0, 31, 32, 77, len(rows) - 1):
        with files[slot // 32].open("rb") as f:
            f.seek(slot % 32 * record)
            doc, start, tokens = struct.unpack("<qqi", f.read(20))
            ids = f.read(2 * shards.STRIDE)
        want = rows[slot]
        assert (None if doc == shards.NONE else doc, start, tokens, ids) == (want.doc_id, want.start, want.tokens, bytes(want.ids))


def test_slots_do_not_depend_on_partitions(spark, docs, tmp_path):
    def order(n: int, partitions: str) -> list[tuple]:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            rows = shards.write_shards(docs.repartition(n), str(tmp_path / f"s{n}"), PATH, key=5, shard=64).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return sorted((r.slot, r.doc_id, r.start, bytes(r.ids)) for r in rows)

    first = order(2, "4")
    assert order(3, "2") == first and order(7, "5") == first


def test_a_doc_id_that_fills_parts_is_cut(spark, tmp_path):
    texts = [f"word{k % 40} and more of it" for k in range(300)]
    many = spark.createDataFrame([(7, t) for t in texts] + [(None, "none"), (1, "one"), (9, None)], "doc_id long, text string").repartition(3)
    source = many.select(F.coalesce("doc_id", F.lit(shards.NONE)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("turn"))
    bounds = shards._bounds(source, 8)
    rows = [tuple(r) for r in source.collect()]
    sizes = Counter(bisect.bisect_right(bounds, r) for r in rows)
    assert max(sizes.values()) < 100 and sum(sizes.values()) == 303
    made = shards.write_shards(many, str(tmp_path / "hot"), PATH, key=3, shard=16).collect()
    assert sorted(r.slot for r in made) == list(range(303)) and Counter(r.doc_id for r in made) == {7: 300, None: 1, 1: 1, 9: 1}


def test_a_resume_opens_its_own_shard(spark, docs, tmp_path):
    out = str(tmp_path / "resume")
    rows = {r.slot: r for r in shards.write_shards(docs, out, PATH, key=5, shard=32).collect()}
    some = shards.read_slots(spark, out, 40, 10)
    assert len(some.inputFiles()) == 1
    assert {r.slot: r for r in some.collect()} == {k: rows[k] for k in range(40, 50)}
    assert {r.slot: r for r in shards.read_slots(spark, out, 0, 10**6).collect()} == rows


def test_tokenizers_that_join_words_encode_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Two  Words here", "UPPER lower <|endoftext|> x", "", "  lead"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [] for r in packing.pieces(frame, path).collect()}
    for r in packing.pieces(frame, path).orderBy("doc_id", "start").collect():
        got[r.doc_id] += struct.unpack(f"<{r.length}I", r.ids)
    assert got == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}


def test_special_tokens_keep_their_case(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "plain"]
    got = {r.doc_id: r.doc_tokens for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).collect() == []
    assert shards.write_shards(none, str(tmp_path / "none"), PATH, key=1).collect() == []
