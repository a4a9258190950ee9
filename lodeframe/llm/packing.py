"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / most) pieces of ``most`` tokens and one
piece for each binary digit of the rest, longest first.  Pieces of equal length
form a bucket, and each is a sequence of its own: no sequence crosses documents,
and as every length is a power of two none is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcastable, in_batches, materialise
from .tokens import binary_array, closed_documents

SEQUENCE, END_ID = 4096, 2


def decompose(sizes: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of ``sizes`` tokens, in order."""
    lengths = [most, *(1 << b for b in range(most.bit_length() - 2, -1, -1))]
    each = np.stack([sizes // most, *((sizes % most) // n % 2 for n in lengths[1:])], axis=1)
    length = np.tile(np.array(lengths), sizes.size).repeat(each.ravel())
    document = np.arange(sizes.size).repeat(each.sum(1))
    begin = np.cumsum(length) - length
    return document, begin - (np.cumsum(sizes) - sizes)[document], length


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    made = np.zeros(most.bit_length(), np.int64)  # pieces so far of each length
    for batch in batches:
        for first, ids, sizes in closed_documents(batch.column("text"), path, end_id):
            document, start, length = decompose(sizes, most)
            power = np.log2(length).astype(np.int64)
            turn = np.empty(power.size, np.int64)
            for k in np.unique(power).tolist():
                own = power == k
                n = int(own.sum())
                turn[own] = np.arange(made[k], made[k] + n)
                made[k] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(document + first)), pa.array(start), pa.array(length), pa.array(sizes[document]), binary_array(ids, length, "<u4"), pa.array(np.full(power.size, part, np.int32)), pa.array(turn)],
                ["doc_id", "start", "length", "doc_tokens", "ids", "part", "turn"],
            )


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, part, turn) of every piece of every document.

    ``ids`` are little-endian unsigned 32-bit integers; ``turn`` counts the
    pieces of one length that a task, ``part``, has made before.  ``end_id`` closes each
    document, so a null or empty text is one piece of one id.  Repeated rows are
    documents of their own; a null doc_id is carried along.  Texts are encoded
    some megabytes at a time, a longer one alone and whole.
    """
    if most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, turn long"
    return in_batches(source, partial(_pieces, path=tokenizer, end_id=end_id, most=most), schema, keep=True)


def bucket(pieces: DataFrame) -> DataFrame:
    """Number the pieces through the buckets, from the longest down: sequence_id, dense from 0, and offset, always 0.

    ``pieces`` is written once, as it stands.  A piece's number is its turn plus
    the count of all that come before its task's share of its bucket: the longer
    ones, and those of its length by earlier tasks.  The counts, a row for each
    task and length, are put in order for each length by itself.
    """
    placed = materialise(pieces, "pieces")
    counts = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # A row for each power of two up to the sequence length.
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("own"))
    bases = materialise(own.join(F.broadcast(firsts), "length").select("length", "part", (F.col("first") + F.col("own")).alias("base")), "bases")
    numbered = placed.join(broadcastable(bases), ["length", "part"]).withColumn("sequence_id", F.col("base") + F.col("turn"))
    return numbered.withColumn("offset", F.lit(0).cast("long")).drop("base", "part", "turn")


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = SEQUENCE) -> DataFrame:
    """Sequences with their ids: pieces() numbered by bucket()."""
    return bucket(pieces(docs, tokenizer, end_id, most))
