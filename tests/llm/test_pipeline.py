"""The pipeline's stages, each on its own input, against plain versions."""

from __future__ import annotations

import re
import zlib

import public_tokenizers
import pytest
from test_linedup import plain
from test_neardocs import plain_kept
from tokenizers import Tokenizer

import corpus_pipeline
from lodeframe.llm import toxicity
from lodeframe.llm.queries import op1_document_fingerprints, queries


def shingles(text: str | None) -> set[str]:
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def stages(spark, smallest, tmp_path_factory):
    """Documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, smallest).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_columns(stages):
    assert all(list(rows[0].asDict()) == corpus_pipeline.COLUMNS for rows in stages[:-1])


def test_toxicity(spark, smallest, stages):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{smallest}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert stages[1] and {r.doc_id for r in stages[0]} - {r.doc_id for r in stages[1]} == bad


def test_line_dedup(stages):
    places = plain([(r.doc_id, r.text) for r in stages[1]])
    for before, after in zip(sorted(stages[1]), sorted(stages[2]), strict=True):
        lines = (before.text or "").split("\n")
        kept = "\n".join(line for k, line in enumerate(lines) if not (before.doc_id, k) in places or not places[before.doc_id, k][3])
        assert (after.doc_id, after.text or "") == (before.doc_id, kept)


def test_near_dedup(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in stages[3]) == [rows[k].doc_id for k in plain_kept([r.text for r in rows])]


def test_decontamination(spark, smallest, stages):
    items = [s for r in spark.read.parquet(f"{smallest}/benchmark.parquet").collect() if (s := shingles(r.text))]
    clean = {r.doc_id for r in stages[3] if not any(len(s & own) >= 0.8 * len(s) for own in [shingles(r.text)] for s in items)}
    assert {r.doc_id for r in stages[4]} == clean


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == total == sum(len(r.ids) // 4 for r in stages[5])


def test_run_gives_the_same(spark, smallest, stages):
    rows = corpus_pipeline.run(spark, smallest).collect()
    digest = lambda r: (r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids)))
    assert sorted(map(digest, rows)) == sorted(map(digest, stages[5]))
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_on_empty_tables(spark, smallest, tmp_path, name):
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{smallest}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries()[name](spark, str(tmp_path)).collect() == []


def test_stages_on_odd_rows(spark, smallest, tmp_path):
    """Nulls, empty and very long texts, repeated rows, shared doc_ids and extra columns, through every stage."""
    same = "one line that is here twice and has some words\nanother line of this text with other words in it"
    rows = [(1, None), (2, ""), (2, ""), (3, same), (3, same), (3, "another text with the same id as the one before it"), (None, "no id but a text of its own, with words"), (None, None), (7, "word " * 300_000), (8, " \n\t\n")]
    docs = spark.createDataFrame([(d, t, None, None, None if t is None else len(t), d, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, tag string")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{smallest}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = docs.withColumns({"node": docs["doc_id"], "tag": docs["source"]})
            ids.append(sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))
    assert ids[1] == ids[2] == ids[0]  # nothing toxic; line dedup keeps every document
    # One of the texts without words stays, and one of the equal ones; clean documents are kept.
    assert ids[3] == ids[4] == [(False, 1), (False, 3), (False, 3), (False, 7), (True, 0)]
    assert {r.doc_id for r in docs.collect()} == {1, 3, 7, None}


def test_one_document_follows_itself(spark, smallest, tmp_path):
    spark.read.parquet(f"{smallest}/documents.parquet").limit(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.near_next for r in op1_document_fingerprints(spark, str(tmp_path)).collect()] == [1.0]
