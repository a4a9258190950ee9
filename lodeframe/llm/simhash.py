"""SimHash near-duplicates: popcount embedding, grid range join, exact check.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two such points is at most the Hamming distance of
the fingerprints, so every link lies within that radius.  The 32 axes are cut
into ``radius + 3`` slabs; a point within the radius differs from another in at
most ``radius`` slabs, so the two share a cell of the grid on some three slabs.
Each fingerprint is put into its cell for every choice of three slabs, cells
are compared block by block, the Manhattan bound filters, and the Hamming
distance decides.  Nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, Forest, block_groups, pairs_by_offset, whole_blocks
from .components import components
from .neardocs import near_documents
from .setjoin import CLASS
from .storage import broadcastable, in_batches, materialise

SEGMENTS, BITS = 32, 2
#: The lower bit of every segment.
LOW = 0x5555555555555555


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``words``-word shingles of lower-cased ``text``, repeats included."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])) if len(found) > words else np.zeros(1, np.int64)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Majority bits of ``hashes``; a tie is 0, as is every bit of none."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view("<u8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = [simhash(shingle_hashes(t.as_py() or b"", words)) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(prints, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fingerprint"])


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the fingerprint (signed long) of each row's whole text; a null text is an empty one."""
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.select(*keep).schema.add("fingerprint", "long")
    return in_batches(source, partial(_fingerprint, words=words), schema)


def segment_counts(fingerprint: Column | str) -> Column:
    """Bit counts of the 32 segments, each in a two-bit field of one long.

    The counts 0, 1, 2 stand there in unary, 00, 01, 11, so that the Manhattan
    distance of two points is the number of differing bits of their codes.
    """
    x = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    one, two = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return F.shiftleft(one.bitwiseAND(two), 1).bitwiseOR(one.bitwiseOR(two))


def slabs(radius: int) -> list[int]:
    """Masks over the count fields: ``radius + 3`` slabs of neighbouring segments."""
    edges = np.linspace(0, SEGMENTS, radius + 4).round().astype(int)
    return [sum(3 << (BITS * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(points: DataFrame, radius: int) -> DataFrame:
    """A row (key, node, fingerprint) for each grid cell, of three slabs, of each point."""
    masks = [_signed(a | b | c) for a, b, c in combinations(slabs(radius), 3)]
    keys = F.array(*[F.xxhash64(F.lit(n), segment_counts("fingerprint").bitwiseAND(F.lit(m))) for n, m in enumerate(masks)])
    return points.select(F.explode(keys).alias("key"), "node", "fingerprint")


def _counts(prints: np.ndarray) -> np.ndarray:
    """segment_counts() of unsigned fingerprints."""
    one, two = prints & np.uint64(LOW), (prints >> np.uint64(1)) & np.uint64(LOW)
    return ((one & two) << np.uint64(1)) | one | two


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each block a forest of its links: at most one row for each member."""
    for table in whole_blocks(batches):
        cols = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "part", "node", "fingerprint")}
        n = table.num_rows
        print_ = cols["fingerprint"].view(np.uint64)
        counts = _counts(print_)
        new = np.ones(n, bool)
        new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])

        def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(counts[a] ^ counts[b]) <= radius  # Manhattan distance of the counts
            ok[ok] = np.bitwise_count(print_[a[ok]] ^ print_[b[ok]]) <= radius
            return ok

        links = Forest(n)
        for a, b in pairs_by_offset(np.flatnonzero(new), n, keep):
            links.add(a, b)
        linked, root = links.hung()
        yield pa.RecordBatch.from_arrays([pa.array(cols["node"][linked]), pa.array(cols["node"][root])], ["a", "b"])


def near_duplicates(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows with doc_id and fingerprint, and maybe more, with component_id and component added.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the least doc_id reachable, itself included; ``component``, one of the
    component's fingerprints, names it even where doc_ids are null.  Equal
    fingerprints are one point, so copies, empty texts and repeated rows cost
    nothing further.  A null doc_id takes part and is never the least unless its
    whole component has none, in which case component_id is null.
    """
    points = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    # The fingerprint itself names the node; it is unique, whatever the doc_ids are.
    points = materialise(points.withColumn("node", F.col("fingerprint")), "points")
    dealt = block_groups(cells(points, radius), "key", "node", block)
    edges = in_batches(dealt, partial(_links, radius=radius), "a long, b long")
    groups = components(edges).select(F.col("node").alias("fingerprint"), "component")
    named = points.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = materialise(named, "named")
    # Written, so that both sides of the joins are plain shuffles and Spark can split a large component and a common text.
    ids = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = materialise(named.join(ids, "component").select("fingerprint", "component_id", "component"), "named")
    return prints.join(named, "fingerprint").select(*prints.columns, "component_id", "component")


def as_hex(fingerprint: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the least doc_id; columns stay.

    SimHash fingerprints of ``words``-word shingles link first, as in
    near_duplicates(); a Jaccard similarity of 0.8 or more of the sets of shingles
    confirms each link.  Texts of that similarity may differ in more than four
    bits, so the exact join of the sets adds the links that fingerprints lack.  A
    null doc_id comes after all others; of different texts with one doc_id the one
    with the least hash stays, of repeated rows any one.
    """
    tag = F.xxhash64("text")
    marked = docs.select("doc_id", "text", tag.alias("tag"))
    near = near_duplicates(materialise(fingerprints(marked, words, ("doc_id", "tag")), "prints"))
    prints, groups = near_documents(docs, words, groups=near.select("doc_id", "tag", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")))
    # One row for each class, so that a common text is no bottleneck of the join.
    classes = prints.groupBy(*CLASS).agg(first.alias("first"))
    named = materialise(classes.join(groups, CLASS, "left"), "named")
    alone = named.where("component is null").select("first")
    joined = named.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first")
    kept = alone.union(joined).select("first.__doc", "first.__tag")
    counted = prints.groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.count(F.lit(1)).alias("__n"))
    kept = materialise(kept.join(counted, kept["__doc"].eqNullSafe(counted["__doc"]) & (kept["__tag"] == counted["__tag"])).select(kept["__doc"], kept["__tag"], "__n"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (tag == F.col("__tag"))
    # As long as the ids may be broadcast, the texts need no shuffle.
    single = docs.join(broadcastable(kept.where("__n = 1")), same, "left_semi")
    more = kept.where("__n > 1")
    if not more.take(1):
        return single
    return single.unionByName(docs.join(more, same, "left_semi").withColumn("__tag", tag).dropDuplicates(["doc_id", "__tag"]).drop("__tag"))
