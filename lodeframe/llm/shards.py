"""Training-order materialisation: a keyed permutation gives every sequence its slot.

Documents, in order of doc_id, are cut into sequences of ``stride`` tokens, the
last of a document padded.  Sequence k of n gets slot ``permute(k)``, a Feistel
network over the next power of four at or above n, walked until the value is
below n: a bijection of 0 .. n - 1 that needs no table.  k depends on the
documents alone, so the same documents and key give the same order however
Spark splits them.

Shard s is one file with the records of slots ``s * shard`` .. ``(s + 1) * shard -
1`` in order, all of one size: slot t begins at byte ``(t % shard) * record`` of
its file, so reading is sequential and resumes anywhere.  A record is doc_id and
start (64 bits each), tokens (32 bits), ``stride`` ids (16 bits, or 32 if the
vocabulary needs them), all little-endian, and a line end, as the files are
written by Spark's text writer.  ``manifest`` tells the sizes; it is written last.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix
from .order import tasks
from .storage import in_batches, materialise, release
from .tokens import closed_documents, encoder

STRIDE, SHARD, PAD_ID, END_ID, ROUNDS = 128, 8192, 0, 2, 6
#: Ids are moved compressed, each document by itself.
CODEC = "zstd"
#: Shards are written in so many goes, each of which reads the ordered documents and moves its own sequences: less stands on disk at once.
GOES = 2
HEAD = 20
#: Stands for a null doc_id; a doc_id of this value is read back as null.
NONE = -(1 << 63)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of ``index`` under the permutation of 0 .. n - 1 that ``key`` chooses."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key % (1 << 64)], np.uint64)))
    out = index.astype(np.uint64)
    walking = np.arange(out.size)
    while walking.size:
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


_DOCUMENT = "part int, doc long, tie long, turn long, tokens long, ids binary"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, kind: str, bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Each document with its ids and the part that its place in the order falls in."""
    codec = pa.Codec(CODEC)
    for batch in batches:
        place = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "turn")), strict=True))
        part = [bisect_right(bounds, p) for p in place]
        for first, ids, size in closed_documents(batch.column("text"), path, end_id):
            some = slice(first, first + size.size)
            cols = [batch.column(c)[some] for c in ("doc", "tie", "turn")]
            data, ends = ids.astype(kind), np.cumsum(size).tolist()
            packed = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(part[some], pa.int32()), *cols, pa.array(size), pa.array(packed, pa.binary())], [f.split()[0] for f in _DOCUMENT.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch], stride: int) -> Iterator[pa.RecordBatch]:
    """Documents in order, with the number of sequences that come before in their part."""
    now, made = -1, 0
    for batch in batches:
        part, n = batch.column("part").to_numpy(), -(-batch.column("tokens").to_numpy() // stride)
        before = np.cumsum(n) - n
        new = np.flatnonzero(np.concatenate(([part[0] != now], part[1:] != part[:-1]))) if part.size else np.empty(0, np.int64)
        base = np.full(part.size, made)
        for at in new.tolist():
            base[at:] = -before[at]
        if part.size:
            now, made = part[-1], int(base[-1] + before[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc", "tokens", "ids")), pa.array(base + before)], ["part", "doc", "tokens", "ids", "first"])


def _records(batches: Iterator[pa.RecordBatch], base: dict[int, int], n: int, key: int, stride: int, pad_id: int, kind: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(slot, record) of each sequence with a slot from ``low`` up to below ``high``."""
    width, codec = np.dtype(kind).itemsize, pa.Codec(CODEC)
    layout = np.dtype([("doc", "<i8"), ("start", "<i8"), ("tokens", "<i4"), ("ids", kind, (stride,))])
    for whole in batches:
        # Documents of about a megabyte of ids at once.
        ends = np.cumsum(whole.column("tokens").to_numpy())
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(1 << 19, int(ends[-1]) if ends.size else 0, 1 << 19)), whole.num_rows)).tolist()
        for begin, stop in zip([0, *cuts], cuts, strict=False):
            batch = whole.slice(begin, stop - begin)
            size = batch.column("tokens").to_numpy()
            count = -(-size // stride)
            document = np.arange(size.size).repeat(count)
            turn = np.arange(document.size) - (np.cumsum(count) - count)[document]
            index = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("first").to_numpy()
            slot = permute(index[document] + turn, n, key)
            wanted = np.flatnonzero((slot >= low) & (slot < high))
            if not wanted.size:
                continue
            # Only documents with a sequence that is wanted now are decoded.
            document, turn = document[wanted], turn[wanted]
            used = np.unique(document)
            packed = zip(batch.column("ids").take(pa.array(used)).to_pylist(), (size[used] * width).tolist(), strict=True)
            ids = np.frombuffer(b"".join(codec.decompress(x, n, asbytes=True) for x, n in packed), kind)
            begins = np.zeros(size.size, np.int64)
            begins[used] = np.cumsum(size[used]) - size[used]
            docs, place = batch.column("doc").to_numpy(), np.arange(stride, dtype=np.int32)
            for at in range(0, wanted.size, 8192):
                d, t = document[at : at + 8192], turn[at : at + 8192]
                out = np.empty(d.size, layout)
                out["doc"], out["start"], out["tokens"] = docs[d], t * stride, np.minimum(size[d] - t * stride, stride)
                cut = ids.take((begins[d] + t * stride)[:, None] + place, mode="clip")
                cut[place >= out["tokens"][:, None]] = pad_id
                out["ids"] = cut
                offsets = (np.arange(d.size + 1) * (HEAD + stride * width)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), d.size, [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(slot[wanted[at : at + 8192]]), data], ["slot", "record"])


def _bounds(source: DataFrame, parts: int) -> list[tuple]:
    """Places (doc, tie, turn) at which the parts begin, the first part's left out: one scan of the doc_ids.

    A doc_id that fills more than a part is cut by its texts' hashes and its rows'
    turns as well, for which the rows of such doc_ids alone are read again.  The
    bounds balance the parts; results don't depend on them.
    """
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = source.agg(F.percentile_approx("doc", shares, max(10000, 20 * parts)).alias("at")).first().at or []
    times = Counter(found)
    hot = [doc for doc, n in times.items() if n > 1]
    bounds = [(doc, NONE, -1) for doc in times]
    if hot:
        order = ["doc", "tie", "turn"]
        rows = source.where(F.col("doc").isin(hot)).select(*order)
        ranged = rows.repartitionByRange(sum(times[d] for d in hot), *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("least"))
        # A row for each partition.
        bounds += [tuple(r.least) for r in ranged.collect()]
    return sorted(set(bounds))


def _ordered(docs: DataFrame, parts: int, tokenizer: str, stride: int, end_id: int, kind: str) -> DataFrame:
    """Documents with their ids, written in order within each part, and the number of sequences that come before in the part."""
    text = F.coalesce("text", F.lit(""))
    # ``turn`` differs between equal rows, so that many of them needn't meet in one part.
    source = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("turn"), text.alias("text"))
    order = ["doc", "tie", "turn"]
    bounds = _bounds(source, parts)
    made = in_batches(source, partial(_encoded, path=tokenizer, end_id=end_id, kind=kind, bounds=bounds), _DOCUMENT, keep=True)
    dealt = made.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", *order)
    return materialise(in_batches(dealt, partial(_counted, stride=stride), "part int, doc long, tokens long, ids binary, first long"), "ordered")


def write_shards(docs: DataFrame, out: str, tokenizer: str, key: int, stride: int = STRIDE, shard: int = SHARD, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Write all sequences of ``docs`` under ``out`` and return them as read_slots() does.

    Documents are ordered by doc_id, nulls first, then by a hash of the text;
    equal rows may change places.  A null or empty text is a sequence of
    ``end_id`` and padding; repeated rows are documents of their own.  Files are
    written by Spark's committer, so a lost executor leaves no half-written shard.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(encoder(tokenizer).vocabulary, end_id + 1, pad_id + 1) <= 1 << 16 else "<u4"
    parts = tasks(docs)
    ordered = _ordered(docs, parts, tokenizer, stride, end_id, kind)
    # The ids are written; their shuffle would stand on disk beside that of the records.
    release(spark)
    sizes = ordered.groupBy("part").agg(F.sum(F.ceil(F.col("tokens") / stride)).alias("n")).collect()
    counts = {r.part: r.n for r in sizes}
    base, n = {}, 0
    for part in sorted(counts):
        base[part], n = n, n + counts[part]

    shards = -(-n // shard)
    each = max(1, -(-shards // (GOES * parts)))
    # Shards of one go: whole partitions of ``each`` shards.
    own = max(1, -(-shards // (GOES * each))) * each
    for go in range(max(1, -(-shards // own))):
        low, high = go * own * shard, min(n, (go + 1) * own * shard)
        if go:
            release(spark)
        records = in_batches(ordered, partial(_records, base=base, n=n, key=key, stride=stride, pad_id=pad_id, kind=kind, low=low, high=high), "slot long, record binary")
        place = ((F.col("slot") - low) / (each * shard)).cast("int")
        dealt = records.repartitionById(own // each, place).sortWithinPartitions("slot")
        dealt.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", shard).text(f"{out}/shards/{go}")
    layout = {"sequences": n, "stride": stride, "shard": shard, "record": HEAD + stride * np.dtype(kind).itemsize + 1, "id_bits": 8 * np.dtype(kind).itemsize, "each": each, "own": own, "key": key}
    spark.createDataFrame([tuple(layout.values())], ", ".join(f"{c} long" for c in layout)).coalesce(1).write.json(f"{out}/manifest")
    return read_slots(spark, out, 0, n)


def _little(data: Column, start: Column, size: int) -> Column:
    """A little-endian number of ``size`` bytes at ``start`` (from 1)."""
    turned = F.concat(*[F.substring(data, start + k, F.lit(1)) for k in range(size - 1, -1, -1)])
    return F.conv(F.hex(turned), 16, -10).cast("long")


def read_slots(spark: SparkSession, out: str, start: int, count: int) -> DataFrame:
    """(slot, shard, doc_id, start, tokens, ids) of slots ``start`` .. ``start + count - 1``.

    Only the files of their shards are opened, and each record is cut out at its
    place.  ``ids`` is the padded sequence as it stands in the file.
    """
    layout = spark.read.json(f"{out}/manifest").first()
    last = min(start + count, layout.sequences) - 1
    none = "slot long, shard long, doc_id long, start long, tokens int, ids binary"
    if last < start:
        return spark.createDataFrame([], none)
    # File c of partition p of go g is shard g * own + p * each + c.
    name = r"/(\d+)/part-(\d+)-[^/]*-c(\d+)\.txt$"
    go, part, file = (F.regexp_extract("path", name, k).cast("long") for k in (1, 2, 3))
    number = go * layout.own + part * layout.each + file
    shards = range(start // layout.shard, last // layout.shard + 1)
    # A resume of some shards opens these files alone.
    paths = [f"{out}/shards/{s // layout.own}/part-{s % layout.own // layout.each:05d}-*-c{s % layout.own % layout.each:03d}.txt" for s in shards] if len(shards) <= 16 else f"{out}/shards/*"
    files = spark.read.format("binaryFile").load(paths).select("path", "content", number.alias("shard")).where("length > 0")
    wanted = files.where(F.col("shard").between(start // layout.shard, last // layout.shard))
    first = F.greatest(F.lit(start), F.col("shard") * layout.shard)
    stop = F.least(F.lit(last), (F.col("shard") + 1) * layout.shard - 1)
    rows = wanted.select("shard", "content", F.explode(F.sequence(first, stop)).alias("slot"))
    at = ((F.col("slot") % layout.shard) * layout.record + 1).cast("int")
    record = rows.select("slot", "shard", F.substring("content", at, F.lit(layout.record - 1)).alias("r"))
    doc = _little(F.col("r"), F.lit(1), 8)
    return record.select(
        "slot", "shard", F.when(doc != NONE, doc).alias("doc_id"), _little(F.col("r"), F.lit(9), 8).alias("start"), _little(F.col("r"), F.lit(17), 4).cast("int").alias("tokens"),
        F.substring("r", F.lit(HEAD + 1), F.lit(layout.record - 1 - HEAD)).alias("ids"),
    )
