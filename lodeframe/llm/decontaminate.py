"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Texts are sets of five-word shingles.  Documents are partitioned by the power of
two of their set size, and a partition's signature has ``SPREAD`` bins for each
shingle of that size: the least hash of each bin.  An item's signature is taken
for every partition, so a short item is compared with a long document at that
document's resolution, and one equal bin makes a candidate.  A candidate is
verified by the exact share of the item's shingles that the document contains.
A shared shingle is missed only if another shadows it in its bin; with eight or
more shingles the chance that all shared ones are is below one in ten thousand.
Shorter items are looked up by every shingle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import broadcastable, materialise

WORDS, SHARE, SPREAD, SHORT = 5, 0.8, 4, 8


def _words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _hashes(words: str) -> Column:
    """Distinct 64-bit hashes of the shingles, sorted."""
    last = F.size(words) - WORDS
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WORDS)]))
    return F.sort_array(F.array_distinct(F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))))


def _shingles(words: str) -> Column:
    """Distinct shingles as text."""
    last = F.size(words) - WORDS
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(F.col(words), i + 1, WORDS), " "))
    return F.array_distinct(F.when(last >= 0, every).otherwise(F.array().cast("array<string>")))


def _held(value: Column) -> Column:
    """``value`` as the one row of a generator.

    The optimiser copies plain columns into filters that it pushes down and into
    the bodies of array functions, where they would be computed again for every
    element; it doesn't copy what a generator gives.
    """
    return F.explode(F.array(value))


def _minima(hashes: Column, bits: Column) -> Column:
    """The least hash of each bin; sorted hashes with the same leading ``bits`` stand together."""
    bin_ = lambda x: F.call_function("shiftrightunsigned", x, 64 - bits)
    return F.filter(hashes, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(hashes, i - 1))))


def _bits(size: Column) -> Column:
    """Leading bits of a partition: SPREAD bins for each shingle of its largest size."""
    return F.greatest(F.ceil(F.log2(size.cast("double"))), F.lit(0)).cast("int") + (SPREAD - 1).bit_length()


def contained_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment, tag) where a document holds ``share`` of an item or more.

    Items of fewer than five words have no shingle and never match, nor do null
    or empty texts.  Rows that share a doc_id are searched one by one, and
    ``tag``, a hash of doc_id and text, tells them apart; equal rows give equal
    results once.  Items that share an item_id are searched one by one too.
    """
    item = items.select("item_id", _held(_words("text")).alias("w")).select("item_id", "w", _held(_hashes("w")).alias("h")).select("item_id", "h", _held(_shingles("w")).alias("s")).where("size(h) > 0")
    item = materialise(item.withColumn("size", F.size("h")).withColumn("item", F.xxhash64("item_id", "s")).dropDuplicates(["item"]), "items")
    doc = docs.select(F.xxhash64("doc_id", "text").alias("tag"), _held(_words("text")).alias("w")).select("tag", _held(_hashes("w")).alias("h"))

    long = item.where(F.col("size") >= SHORT).select("item", "h", F.explode(F.sequence(F.lit((SPREAD - 1).bit_length()), F.lit(40))).alias("bits"))
    long = materialise(long.select("item", "bits", F.explode(_minima(F.col("h"), F.col("bits"))).alias("least")), "signatures")
    signed = doc.select("tag", "h", _held(_bits(F.size("h"))).alias("bits")).select("tag", "bits", F.explode_outer(_minima(F.col("h"), F.col("bits"))).alias("least"))
    found = signed.join(broadcastable(long), ["bits", "least"]).select("tag", "item")
    short = item.where(F.col("size") < SHORT)
    if short.take(1):
        every = materialise(short.select("item", F.explode("h").alias("least")), "short")
        found = found.union(doc.select("tag", F.explode_outer("h").alias("least")).join(broadcastable(every), "least").select("tag", "item"))
    pairs = materialise(found.distinct(), "candidates")

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tag"))
    met = texts.join(broadcastable(pairs), "tag").join(broadcastable(item.select("item", "item_id", "s")), "item")
    shared = met.select("doc_id", "item_id", "tag", "s", "item", _held(_words("text")).alias("w"))
    shared = shared.select("doc_id", "item_id", "tag", "item", _held(F.size(F.array_intersect(_shingles("w"), "s"))).alias("shared"), F.size("s").alias("item_shingles"))
    share_ = F.col("shared") / F.col("item_shingles")
    kept = shared.withColumn("containment", share_).where(F.col("shared") >= share * F.col("item_shingles"))
    return kept.dropDuplicates(["tag", "item"]).select("doc_id", "item_id", "shared", "item_shingles", "containment", "tag")


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that contain an item; columns as they were."""
    found = materialise(contained_items(docs, items, share).select(F.col("tag").alias("__tag")).distinct(), "contaminated")
    return docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(broadcastable(found), F.col("__key") == F.col("__tag"), "left_anti").select(docs.columns)
