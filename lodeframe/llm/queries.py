"""The registered queries of this subpackage; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, lcp, licenses, linedup, manifest, packing, personal, shards, simhash, sql, toxicity, urlfilter
from .storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.fingerprints(_table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.write_shards(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), word_tokenizer(), key=20240601)
    return written.select("doc_id", "start", "tokens", "slot", "shard", F.crc32("ids").alias("ids_crc32"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_pairs(chat.next_as_rejected(chat.conversations(_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("pair_id", "prefix_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(_table(spark, sf_dir, "documents"), word_tokenizer())
    digest = made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "turn")
    return packing.bucket(digest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending_sentences")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages: those whose page_id has a row in ``labels``; bad is a quality of 0."""
    bad = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"), bad)
    return judged.withColumns({c: F.round(c, 9) for c in ("bad_mean", "bad_bound")})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.matched_lines(_table(spark, sf_dir, "documents")).drop("tag")


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.materialise(simhash.fingerprints(_table(spark, sf_dir, "documents")), "prints")
    return simhash.near_duplicates(prints).select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"), manifest.tampered())


def aligned_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"), *aligned_tokenizers())


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
