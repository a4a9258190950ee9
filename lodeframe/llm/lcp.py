"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up.  At each level runs of one symbol become a symbol;
deterministic coin tossing against the left neighbour (lowest differing bit and
its value), three times over, leaves labels of at most three bits; local maxima
of the labels open blocks; a block is named by a hash of its symbols, and the
names are the symbols of the next level.  A name depends on its own characters
and on a few symbols beside them, never on the offset, so equal substrings get
the same names in their interior.

A fingerprint keeps, for each of 64 bins of the names of levels 2 and 3
(phrases of some 8 and 22 characters, repeats counted one by one), 16 bits of
the least name.  The likeness
of two fingerprints is the share of equal bins among those that either fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import mix, powers
from .order import tasks
from .storage import in_batches, materialise

BINS = 64
EMPTY = 0xFFFF
LEVELS = (2, 3)
#: Characters parsed at once, each text counted as one more; a longer text is parsed alone.
CHUNK = 1 << 19


def _toss_table(bits: int) -> np.ndarray:
    """Label of every (own, left) pair of ``bits``-bit labels; equal ones, at a text's start, give 0."""
    own, left = np.divmod(np.arange(1 << (2 * bits)), 1 << bits)
    low = (own ^ left) & -(own ^ left)
    place = np.bitwise_count(np.maximum(low - 1, 0))
    return np.where(own == left, 0, 2 * place + ((own & low) != 0)).astype(np.uint8)


#: 7-bit labels come from 64-bit symbols, 4-bit ones from those, 3-bit ones from those.
_SECOND, _THIRD = _toss_table(7), _toss_table(4)


def _labels(symbol: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Three-bit labels; neighbours within a text differ in their symbols and so in their labels."""
    left = np.empty_like(symbol)
    left[1:] = symbol[:-1]
    left[head] = ~symbol[head]  # a text's first symbol differs from it in bit 0
    differ = symbol ^ left
    low = differ & (~differ + symbol.dtype.type(1))
    label = (np.bitwise_count(low - symbol.dtype.type(1)) << 1) | ((symbol & low) != 0)
    for table, bits in ((_SECOND, 7), (_THIRD, 4)):
        pair = label.astype(np.uint16) << bits
        pair[1:] |= label[:-1]
        pair[head] = (label[head].astype(np.uint16) << bits) | (label[head] ^ 1)
        label = table[pair]
    return label


def _level(symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of each text and the texts' new offsets; ``offsets`` as in Arrow."""
    n = symbol.size
    if not n:
        return symbol.astype(np.uint64), offsets
    filled = offsets[:-1][np.diff(offsets) > 0]
    new = np.ones(n, bool)
    new[1:] = symbol[1:] != symbol[:-1]
    new[filled] = True
    at = np.flatnonzero(new)
    if at.size < n:
        run = np.diff(np.append(at, n))
        symbol = symbol[at]
        long = np.flatnonzero(run > 1)
        symbol[long] = mix(symbol[long].astype(np.uint64) + (run[long].astype(np.uint64) << np.uint64(40))).astype(symbol.dtype)
        offsets = np.searchsorted(at, offsets)
        filled = offsets[:-1][np.diff(offsets) > 0]
        n = at.size
    label = _labels(symbol, filled)
    cut = np.zeros(n, bool)
    cut[1:] = label[1:] > label[:-1]
    cut[:-1] &= label[:-1] > label[1:]
    cut[-1] = False
    last = filled[1:] - 1
    cut[last] = False  # a text's last symbol opens no block
    cut[filled] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    place = np.arange(n, dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    part = symbol.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)
    part *= powers(int(size.max()))[place]
    return mix(np.add.reduceat(part, start) + size.astype(np.uint64)), np.searchsorted(start, offsets)


def _occurrences(symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and name of each symbol, where the second of a text has another name than the first, and so on."""
    text = np.repeat(np.arange(offsets.size - 1, dtype=np.uint64), np.diff(offsets))
    both = np.sort((text << np.uint64(44)) | (symbol >> np.uint64(20)))
    new = np.ones(both.size, bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    turn = np.arange(both.size) - np.repeat(at, np.diff(np.append(at, both.size)))
    return (both >> np.uint64(44)).astype(np.int64), mix((both << np.uint64(20)) ^ mix(turn.astype(np.uint64)))


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS values, 16 bits or EMPTY, for each text."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    symbol = chars
    for level in range(1, max(LEVELS) + 1):
        symbol, offsets = _level(symbol, offsets)
        if level in LEVELS:
            text, name = _occurrences(symbol, offsets)
            name = mix(name + np.uint64(level))
            np.minimum.at(least, text * BINS + (name >> np.uint64(58)).astype(np.int64), name)
    value = (mix(least) % np.uint64(EMPTY)).astype(np.uint16)
    value[least == np.iinfo(np.uint64).max] = EMPTY
    return value.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either row; two empty ones are alike."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(either == 0, 1.0, equal / np.maximum(either, 1))


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many characters of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of _SCHEMA; ``following``: the text after each."""
    edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    chained = all(a is b for a, b in zip(texts[1:], following, strict=False))
    whole = sketches([*texts, following[-1]]) if chained else sketches(texts + following)
    own, other = (whole[:-1], whole[1:]) if chained else (whole[: len(texts)], whole[len(texts) :])
    changed = sketches(edited)
    text = lambda rows: [r.tobytes().hex() for r in rows.astype(">u2")]
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array(text(own)), pa.array(text(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, other)),
    ]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each compared with the next.  Edge 1: the last row, whose next is elsewhere; edge 2: the first."""
    names = [*_NAMES, "part", "edge", "text"]

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        part, doc, text = row
        blank = [pa.array([doc], pa.int64()), *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
        return pa.RecordBatch.from_arrays([*blank, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text])], names)

    def done(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        cols = _compare([r[1] for r in rows[:-1]], texts[:-1], texts[1:])
        n = len(rows) - 1
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[0] for r in rows[:-1]], pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names)

    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
            if not held:
                yield edge(2, row)
            held.append(row)
            chars += len(row[2]) + 1
            if chars >= CHUNK and len(held) > 1:
                yield done(held)
                held, chars = held[-1:], len(held[-1][2])
    if len(held) > 1:
        yield done(held)
    if held:
        yield edge(1, held[-1])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield pa.RecordBatch.from_arrays(_compare([doc], [text], [following]), _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text and of its edited text, compared.

    The edited text has its last third (rounded down) replaced by the first as
    many code points of the next document by descending doc_id; the last is
    followed by the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited (likeness to the edited text) and near_next
    (likeness to the next document).

    A null text is an empty one; two empty texts have a likeness of 1.  Null
    doc_ids come last; rows that share a doc_id are ordered by a hash of the text.

    Texts are moved once, to be range-partitioned by doc_id and sorted; each task
    compares neighbours as they pass.  Only the first and the last row of each
    partition are matched up afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(tasks(docs), *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    seen = materialise(in_batches(ranged, _stream, f"{_SCHEMA}, part int, edge int, text string"), "fingerprints")
    # The numbers of the partitions are put in order alone, then their first texts are moved once, each by itself.
    firsts = seen.where("edge = 2").select(F.col("part").alias("next"), F.col("text").alias("following"))
    parts = Window.orderBy("part")
    wrap = F.first("part").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = seen.where("edge = 2").select("part").select("part", F.coalesce(F.lead("part").over(parts), wrap).alias("next"))
    ends = seen.where("edge = 1").select("part", "doc_id", "text").join(after, "part").join(firsts, "next")
    return seen.where("edge = 0").select(*_NAMES).union(in_batches(ends, _join_edges, _SCHEMA))
