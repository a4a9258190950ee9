"""An exact self-join of sets at a Jaccard similarity of 0.8 or more.

Line dedup joins lines as sets of words, the near-document join texts as sets of
shingles; both are written here.  An element has two independent 64-bit names,
128 bits in all, and equal sets form a class with a name of 96 bits, so no
result rests on a short hash.

Elements are ordered by rarity: the first ``n - ceil(0.8 n) + 1`` of two matching
sets share one.  Classes meet at those prefix elements; length, position and a
bitmap filter the pairs, and within bounded blocks the whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_groups, pairs_by_offset, weighed_blocks, whole_blocks
from .bytewords import mix
from .order import tasks
from .storage import BATCH_BYTES, in_batches, materialise, release

#: Element counts are kept for this many hash buckets: the table that tasks get is 4 MB, whatever the input.
BUCKETS = 1 << 20
PART = 4096
#: Bits of a token below its bucket's rank; a token is never negative.
REST = np.uint64(43)
#: Sets of up to so many elements have bitmaps of 64 and of 128 bits; larger ones have 256.
NARROW, MEDIUM = 96, 200
#: Prefix rows that a task holds before it gives them out, and those after which it looks for large groups.
HELD = 1 << 18
#: Elements counted for each share of the prefix rows, and shares for each task at least.
SHARED, EACH = 1 << 20, 32
#: Blocks of up to so many sets are verified many at once.
FEW = 64
#: Most elements, and most sets, in each half of a block that is verified.
ELEMENTS, MEMBERS = 1 << 18, 2048

CLASS = ["node", "tail"]
PREFIX = ["key", "node", "tail", "size", "b0", "b1", "b2", "b3"]
PREFIX_TYPES = {c: "int" if c == "tail" else "long" for c in PREFIX}
#: Prefix rows of one share, column by column.
PACKED = "share int, rows int, data binary"
_FOUND = "node long, tail int, key long, size long, others long"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


@dataclass
class Sets:
    """Distinct elements of groups (lines, texts), in order of token: a run for each group that has any.

    ``opens`` is the first element of each group in the input.
    """

    token: np.ndarray
    check: np.ndarray
    first: np.ndarray
    n: np.ndarray
    opens: np.ndarray
    node: np.ndarray
    tail: np.ndarray


def _ids(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct (name, check), ordered by name, and each element's number among them."""
    order = np.argsort(name)
    ordered, second = name[order], check[order]
    new = np.ones(order.size, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (~new[1:] & (second[1:] != second[:-1])).any():  # two elements of one name
        order = np.lexsort((check, name))
        ordered, second = name[order], check[order]
        new[1:] = (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])
    number = np.empty(order.size, np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def bucket(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(44)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if x.size else np.empty(0, np.int64)


def distinct(name: np.ndarray, check: np.ndarray, group: np.ndarray, rank: np.ndarray | None = None) -> Sets:
    """Sets of the elements (name, check) of each ``group``; groups come in order.

    With ``rank``, a rank of each bucket, tokens are ordered by it.
    """
    at, local = _ids(name, check)
    own, second = name[at], check[at]
    place = bucket(own) if rank is None else rank[bucket(own)]
    token = (place.astype(np.uint64) << REST) | ((own & np.uint64((1 << 44) - 1)) >> np.uint64(1))
    if rank is not None:
        order = np.argsort(token, kind="stable")
        turn = np.empty(order.size, np.int64)
        turn[order] = np.arange(order.size)
        local, token, own, second = turn[local], token[order], own[order], second[order]
    opens = _runs(group)
    size = np.diff(np.append(opens, group.size))
    bits = max(1, int(token.size).bit_length())
    both = np.sort((np.repeat(np.arange(opens.size), size) << bits) | local)
    both = both[_runs(both)]
    local, row = both & ((1 << bits) - 1), both >> bits
    first = _runs(row)
    n = np.diff(np.append(first, row.size))
    if not first.size:
        return Sets(token, second, first, n, opens, np.empty(0, np.int64), np.empty(0, np.int32))
    count = n.astype(np.uint64)
    node = mix(np.add.reduceat(mix(own + np.uint64(1))[local], first) + count).view(np.int64)
    tail = (mix(np.add.reduceat(mix(second + np.uint64(1))[local], first) + count) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return Sets(token[local], second[local], first, n, opens, node, tail)


class Seen:
    """The classes that a task has come across lately, to give most of them out once."""

    def __init__(self) -> None:
        self.node, self.tail = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32)

    def fresh(self, s: Sets) -> np.ndarray:
        """Sets that are the first of their class here, as far as is known."""
        order = np.lexsort((s.tail, s.node))
        node, tail = s.node[order], s.tail[order]
        new = np.ones(order.size, bool)
        new[1:] = (node[1:] != node[:-1]) | (tail[1:] != tail[:-1])
        slot = node & (BUCKETS - 1)
        new &= (self.node[slot] != node) | (self.tail[slot] != tail)
        self.node[slot], self.tail[slot] = node, tail
        return np.sort(order[new])


# How often elements occur


def count(counts: np.ndarray, name: np.ndarray) -> None:
    """Add the elements to ``counts`` of their buckets."""
    np.add.at(counts, bucket(name), 1)


def count_rows(counts: np.ndarray) -> pa.RecordBatch:
    """(a, counts) rows of PART buckets each, from bucket ``a`` on; 32 bits a count where they do."""
    kind = np.uint32 if counts.max() < 1 << 32 else np.uint64
    data = [counts[at : at + PART].astype(kind).tobytes() for at in range(0, BUCKETS, PART)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(0, BUCKETS, PART)), pa.array(data, pa.binary())], ["a", "counts"])


def _part(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * PART else np.uint64).astype(np.int64)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("a").to_pylist(), batch.column("counts"), strict=True):
            total[at] = total.get(at, 0) + _part(counts.as_py())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c.astype(np.uint64).tobytes() for c in total.values()], pa.binary())], ["a", "counts"])


def rarity(parts: DataFrame) -> tuple[np.ndarray, int, int]:
    """Rank of each bucket, rarest first, the number of buckets with one element or none, and of shares, from count_rows()."""
    spread = parts.select("a", "counts").repartition(min(tasks(parts), BUCKETS // PART), "a")
    # BUCKETS counts, whatever the input.
    summed = in_batches(spread, _sum_counts, "a long, counts binary").toArrow()
    count = np.zeros(BUCKETS, np.int64)
    for at, counts in zip(summed.column("a").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        count[at : at + PART] = _part(counts)
    rank = np.empty(BUCKETS, np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
    return rank, int((count <= 1).sum()), max(EACH * tasks(parts), int(count.sum()) // SHARED)


# Candidates


def bitmaps(s: Sets) -> list[np.ndarray]:
    """256-bit bitmaps of token parities in four words; smaller sets have theirs folded to 64 or 128 bits."""
    place = mix(s.token)
    word, bit = place >> np.uint64(62), np.uint64(1) << ((place >> np.uint64(40)) & np.uint64(63))
    b = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), s.first) for k in range(4)]
    two, one = s.n <= MEDIUM, s.n <= NARROW
    b[0], b[1] = np.where(two, b[0] ^ b[2], b[0]), np.where(two, b[1] ^ b[3], b[1])
    b[0] = np.where(one, b[0] ^ b[1], b[0])
    zero = np.uint64(0)
    return [b[0], np.where(one, zero, b[1]), np.where(two, zero, b[2]), np.where(two, zero, b[3])]


def prefix_rows(s: Sets, pick: np.ndarray, single: int, wide: bool) -> pa.RecordBatch:
    """Rows of PREFIX for the sets ``pick``; ``size`` is the number of elements and, below it, the place of the token.

    Two different sets of three or fewer elements can't match, and an element in
    a bucket with a count of one is in no other set; neither gets a row.  Bitmaps
    have 128 bits at most unless they are ``wide``.
    """
    pick = pick[s.n[pick] > 3]
    n = s.n[pick]
    size = n - (4 * n + 4) // 5 + 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(pick, size)
    key = s.token[s.first[row] + place]
    keep = (key >> REST) >= np.uint64(single)
    row, place, key = row[keep], place[keep], key[keep]
    b = bitmaps(s) if row.size else [np.empty(0, np.uint64)] * 4
    if not wide and row.size:
        # Folding keeps the number of differing bits a lower bound.
        zero = np.zeros(s.n.size, np.uint64)
        b = [b[0] ^ b[2], b[1] ^ b[3], zero, zero]
    bits = [pa.array(x[row].view(np.int64)) for x in b]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s.node[row]), pa.array(s.tail[row]), pa.array((s.n[row].astype(np.int64) << 32) | place), *bits], PREFIX)


def packed(parts: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED for prefix_rows(): those of one key are all in one share."""
    held: list[pa.RecordBatch] = []
    n = 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= HELD:
            yield from _packed(held, shares)
            n = 0
    if n:
        yield from _packed(held, shares)


def _packed(held: list[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Packs the rows ``held`` and empties it: one column after the other, and some shares at a time, so that few copies stand at once."""

    def column(name: str) -> np.ndarray:
        return np.concatenate([x.column(name).to_numpy() for x in held])

    size = column("size")
    n, place = size >> 32, size & 0xFFFFFFFF
    share = (mix(column("key").view(np.uint64)) % np.uint64(shares)).astype(np.uint32)
    # Rows of narrow bitmaps lie together, so that what they leave empty costs nothing.
    order = np.argsort(share * np.uint32(3) + (n > NARROW) + (n > MEDIUM), kind="stable")
    kind = np.uint16 if n.max() < 1 << 16 else np.uint32
    out = [column(c)[order] for c in ("key", "node", "tail")] + [n.astype(kind)[order], place.astype(kind)[order]] + [column(f"b{k}")[order] for k in range(4)]
    held.clear()
    share = share[order]
    del size, n, place, order
    start = _runs(share)
    stop = np.append(start[1:], share.size)
    most, at = BATCH_BYTES // sum(x.itemsize for x in out), 0
    while at < start.size:
        end = max(at + 1, int(np.searchsorted(stop, start[at] + most, "right")))
        data = [b"".join([x[a:b].tobytes() for x in out]) for a, b in zip(start[at:end].tolist(), stop[at:end].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(share[start[at:end]].view(np.int32)), pa.array((stop - start)[at:end].astype(np.int32)), pa.array(data, pa.binary())], ["share", "rows", "data"])
        at = end


def _unpacked_rows(data: bytes, rows: int) -> dict[str, np.ndarray]:
    """PREFIX columns from one row of PACKED."""
    at = 0

    def take(kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, rows, at)
        at += out.nbytes
        return out

    cols = {"key": take(np.int64), "node": take(np.int64), "tail": take(np.int32)}
    kind = np.uint16 if len(data) == 56 * rows else np.uint32
    n = take(kind).astype(np.int64)
    cols["size"] = (n << 32) | take(kind)
    return cols | {f"b{k}": take(np.int64) for k in range(4)}


def _together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in PREFIX}


def whole_groups(batches: Iterator[pa.RecordBatch], block: int, rows: int = 65536) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """From rows of PACKED in order of share: (columns, False) for whole groups of a key, sorted by key and class.

    A group of over ``block`` rows is handed on piece by piece as (columns, True),
    never held; it is for block_groups() to deal out.
    """
    held: list[dict[str, np.ndarray]] = []
    n, most, now = 0, HELD, None
    over = np.empty(0, np.int64)  # keys of large groups that have begun to be handed on

    def parted() -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Rows of large groups, and the others."""
        nonlocal over
        cols = _together(held)
        key, count = np.unique(cols["key"], return_counts=True)
        over = np.union1d(over, key[count > block])
        large = np.isin(cols["key"], over) if over.size else np.zeros(n, bool)
        return tuple({c: v[pick] for c, v in cols.items()} for pick in (large, ~large))

    def last() -> Iterator[tuple[dict[str, np.ndarray], bool]]:
        large, small = parted()
        if large["key"].size:
            yield large, True
        if small["key"].size:
            order = np.lexsort((small["tail"], small["node"], small["key"]))
            yield {c: v[order] for c, v in small.items()}, False

    for batch in batches:
        for share, count, data in zip(batch.column("share").to_pylist(), batch.column("rows").to_pylist(), batch.column("data"), strict=True):
            if share != now and n >= rows:
                yield from last()
                held, n, most, over = [], 0, HELD, over[:0]
            now = share
            held.append(_unpacked_rows(data.as_py(), count))
            n += count
            if n > most:
                large, small = parted()
                if large["key"].size:
                    yield large, True
                held, n = [small], small["key"].size
                most = max(HELD, 2 * n)
    if n:
        yield from last()


def need(total: np.ndarray) -> np.ndarray:
    """Least overlap of two sets of ``total`` elements together at a Jaccard similarity of 0.8."""
    return (4 * total + 8) // 9


def _near(cols: dict[str, np.ndarray], start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the groups from ``start`` on that pass the length, position and bitmap filters."""
    n, left = cols["size"] >> 32, (cols["size"] >> 32) - (cols["size"] & 0xFFFFFFFF)
    b = [cols[f"b{k}"].view(np.uint64) for k in range(4)]
    pair = [b[0] ^ b[2], b[1] ^ b[3]]
    one = pair[0] ^ pair[1]
    parts = cols.get("part")
    apart = cols["i"] != cols["j"] if parts is not None else None

    def keep(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = n[x], n[y]
        least = need(nx + ny)
        most = nx + ny - 2 * least
        ok = (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (np.minimum(left[x], left[y]) >= least)
        ok &= np.bitwise_count(one[x] ^ one[y]) <= most
        if parts is not None:
            ok &= ~(apart[x] & (parts[x] == parts[y]))
        for over, words in ((NARROW, pair), (MEDIUM, b)):
            at = np.flatnonzero(ok & (np.minimum(nx, ny) > over))
            if at.size:
                differ = sum(np.bitwise_count(v[x[at]] ^ v[y[at]]).astype(np.int64) for v in words)
                ok[at[differ > most[at]]] = False
        return ok

    return pairs_by_offset(start, n.size, keep)


def _found(cols: dict[str, np.ndarray], new: np.ndarray) -> list[pa.Array]:
    """Columns of _FOUND: a row for each member with a candidate in its group; ``others`` names the set of them."""
    again = np.zeros(new.size, bool)
    again[1:] = ~new[1:] & (cols["node"][1:] == cols["node"][:-1]) & (cols["tail"][1:] == cols["tail"][:-1])
    cols = {c: v[~again] for c, v in cols.items()}
    name = mix(cols["node"].view(np.uint64) ^ mix(cols["tail"].view(np.uint32).astype(np.uint64)))
    others, met = np.zeros(name.size, np.uint64), np.zeros(name.size, bool)
    for a, b in _near(cols, np.flatnonzero(new[~again])):
        np.add.at(others, a, name[b])
        np.add.at(others, b, name[a])
        met[a] = met[b] = True
    pick = np.flatnonzero(met)
    return [pa.array(x) for x in (cols["node"][pick], cols["tail"][pick], cols["key"][pick], cols["size"][pick] >> 32, others[pick].view(np.int64))]


def _candidates(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND for groups of up to ``block`` rows; the rows of larger groups as they are, in the columns behind."""
    names = [*_FOUND_NAMES, *(f"o_{c}" for c in PREFIX)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    behind = [pa.int32() if c == "tail" else pa.int64() for c in PREFIX]
    for cols, over in whole_groups(batches, block):
        if over:
            rows = [pa.array(cols[c]) for c in PREFIX]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows[0]), t) for t in types), *rows], names)
            continue
        out = _found(cols, np.concatenate(([True], cols["key"][1:] != cols["key"][:-1])))
        yield pa.RecordBatch.from_arrays([*out, *(pa.nulls(len(out[0]), t) for t in behind)], names)


def _heads(cols: dict[str, np.ndarray], n: int) -> np.ndarray:
    new = np.ones(n, bool)
    new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])
    return new


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_blocks(batches):
        cols = {c: table.column(c).to_numpy() for c in (*PREFIX, "i", "j", "part")}
        yield pa.RecordBatch.from_arrays(_found(cols, _heads(cols, table.num_rows)), _FOUND_NAMES)


def candidates(rows: DataFrame, block: int) -> DataFrame:
    """(node, tail, key, size) of the classes that have a candidate at a prefix token ``key``, from packed().

    Where two tokens give a class the same candidates, the first is enough: a
    pair's first common token is kept by both of its classes.
    """
    # The prefix rows are the largest shuffle: those of earlier steps are let go before it, and it after.
    release(rows.sparkSession)
    dealt = rows.repartition(tasks(rows), "share").sortWithinPartitions("share")
    behind = ", ".join(f"o_{c} {t}" for c, t in PREFIX_TYPES.items())
    near = materialise(in_batches(dealt, partial(_candidates, block=block), f"{_FOUND}, {behind}"), "near")
    over = near.where("o_key is not null").select(*(F.col(f"o_{c}").alias(c) for c in PREFIX))
    near = near.where("node is not null").select(*_FOUND_NAMES)
    if over.take(1):
        # A class may have come from several tasks.
        over = over.dropDuplicates(["key", *CLASS])
        near = near.union(in_batches(block_groups(over, "key", "node", block), _block_candidates, _FOUND))
    met = near.groupBy(*CLASS, "others").agg(F.min(F.struct("key", "size")).alias("at"))
    met = materialise(met.select(*CLASS, "at.*").distinct(), "met")
    release(met.sparkSession)
    return met


# Verification


def pack_sets(s: Sets) -> pa.Array:
    """Each set as binary: its tokens, then its checks."""
    spans = zip(s.first.tolist(), (s.first + s.n).tolist(), strict=True)
    return pa.array([s.token[a:b].tobytes() + s.check[a:b].tobytes() for a, b in spans], pa.binary())


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and checks of sets from pack_sets(), one after the other."""
    token = [np.frombuffer(d, np.uint64, len(d) // 16) for d in data]
    check = [np.frombuffer(d, np.uint64, len(d) // 16, len(d) // 2) for d in data]
    return tuple(np.concatenate(x) if x else np.empty(0, np.uint64) for x in (token, check))


def overlaps(own: list[bytes], other: list[bytes]) -> np.ndarray:
    """How many elements each set of ``own`` shares with the one of ``other`` at its place, both from pack_sets()."""
    _, number = _ids(*_unpacked([*own, *other]))
    row = np.repeat(np.concatenate((np.arange(len(own)),) * 2), [len(d) // 16 for d in (*own, *other)])
    both = np.sort((row << 32) | number)
    return np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(own))


class Block:
    """Some sets that share the token ``key``, to be compared with one another; ``part``: parts that must differ."""

    DENSE, COLUMNS, CELLS = 64, 1024, 1 << 21

    def __init__(self, data: list[bytes], key: int, part: np.ndarray | None = None) -> None:
        self.size = np.array([len(d) // 16 for d in data], np.int64)
        self.part = part
        token, check = _unpacked(data)
        at, column = _ids(token, check)
        low, high = np.searchsorted(token[at], [key, key + 1])
        count = np.bincount(column, minlength=at.size)
        row = np.repeat(np.arange(len(data)), self.size)
        # Several elements with the key's token: the sets must share one of them.
        self.same = [row[column == c] for c in range(low, high)] if high - low > 1 else None
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        self.row, column = row[order], column[order]
        self.early = column < low
        start = _runs(column)
        n = np.diff(np.append(start, column.size))
        self.begin, self.count = np.repeat(start, n), np.repeat(n, n)
        dense = np.flatnonzero(n > self.DENSE)
        self.wide = np.repeat(n > self.DENSE, n)
        self.groups = [(start[c], n[c], bool(column[start[c]] < low)) for c in dense]
        self.grids = [self._grid(k) for k in range(0, len(self.groups), self.COLUMNS)] if len(self.groups) <= self.COLUMNS else None

    def _grid(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Members by widely shared elements, COLUMNS of them from ``at`` on, and which of these come before the key."""
        some = self.groups[at : at + self.COLUMNS]
        grid = np.zeros((self.size.size, len(some)), np.float32)
        for c, (start, n, _) in enumerate(some):
            grid[self.row[start : start + n], c] = 1
        return grid, np.array([e for _, _, e in some], bool)

    def tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, matrix): whether members from that row on are linked to each of all, above the diagonal only."""
        n = self.size.size
        step = max(1, self.CELLS // n)
        by_row = np.flatnonzero(~self.wide)
        by_row = by_row[np.argsort(self.row[by_row], kind="stable")]
        owner = self.row[by_row]
        for at in range(0, n, step):
            stop = min(n, at + step)
            mine = by_row[np.searchsorted(owner, at) : np.searchsorted(owner, stop)]
            many = self.count[mine]
            other = self.row[np.repeat(self.begin[mine], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            flat = np.repeat((self.row[mine] - at) * n, many) + other
            overlap = np.bincount(flat, minlength=(stop - at) * n).reshape(stop - at, n)
            early = np.zeros((stop - at, n), bool)
            early.reshape(-1)[flat[np.repeat(self.early[mine], many)]] = True
            for grid, first in self.grids if self.grids is not None else map(self._grid, range(0, len(self.groups), self.COLUMNS)):
                overlap += (grid[at:stop] @ grid.T).astype(np.int64)
                if first.any():
                    early |= grid[at:stop][:, first] @ grid[:, first].T > 0
            ok = (overlap >= need(self.size[at:stop, None] + self.size[None, :])) & ~early
            ok &= np.arange(n)[None, :] > np.arange(at, stop)[:, None]
            if self.same is not None:
                alike = np.zeros(ok.shape, bool)
                for rows in self.same:
                    alike[np.ix_(rows[(rows >= at) & (rows < stop)] - at, rows)] = True
                ok &= alike
            if self.part is not None:
                ok &= self.part[at:stop, None] != self.part[None, :]
            yield at, ok


def _few(data: list[bytes], number: np.ndarray, key: np.ndarray, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of linked sets within many small blocks at once; ``number`` and ``key`` are those of each set's block."""
    m = len(data)
    size = np.array([len(d) // 16 for d in data], np.int64)
    token, check = _unpacked(data)
    _, column = _ids(token, check)
    row = np.repeat(np.arange(m), size)
    # Elements of one block stand together, in it those that are the same.
    both = (number[row] << 32) | column
    order = np.argsort(both, kind="stable")
    both = both[order]
    early, first = (token < key[row].view(np.uint64))[order], (token == key[row].view(np.uint64))[order]
    row = row[order]
    start = _runs(number)
    many = np.diff(np.append(start, m))
    # A cell for each two sets of a block.
    within = np.arange(m) - np.repeat(start, many)
    base = np.repeat(np.cumsum(many * many) - many * many, many) + within * np.repeat(many, many)
    cells = int((many * many).sum())
    overlap, before, alike = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(cells, bool)
    for a, b in pairs_by_offset(_runs(both), both.size, lambda a, b: np.ones(a.size, bool)):
        at = base[row[a]] + within[row[b]]
        overlap += np.bincount(at, minlength=cells)
        before[at[early[a]]] = True
        alike[at[first[a]]] = True
    # Each pair counts at its first common token alone.
    found = np.flatnonzero(alike & ~before)
    a = np.searchsorted(base, found, "right") - 1
    # The cells of a set go from its base on, one for each set of its block.
    b = np.repeat(start, many)[a] + found - base[a]
    ok = overlap[found] >= need(size[a] + size[b])
    if part is not None:
        ok &= (part[a] < 0) | (part[a] != part[b])
    return a[ok], b[ok]


def verified_blocks(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ()) -> Iterator[tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of one or more blocks, those of a block ordered by the columns ``by``, and their links: pairs a < b of rows, some at a time."""

    def large(data: list[bytes], key: int, part: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, ok in Block(data, key, part).tiles():
            a, b = np.nonzero(ok)
            yield a + at, b

    for table in whole_blocks(batches, rows=1024):
        cols = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "part")}
        head = _heads(cols, table.num_rows)
        number = np.cumsum(head) - 1
        if by:
            order = np.lexsort([*(table.column(c).to_numpy() for c in reversed(by)), number])
            table, cols = table.take(pa.array(order)), {c: v[order] for c, v in cols.items()}
        data = [x.as_py() for x in table.column("elements")]
        apart = cols["i"] != cols["j"]
        part = np.where(apart, cols["part"], -1).astype(np.int64)
        start = np.append(np.flatnonzero(head), table.num_rows)
        weight = np.concatenate(([0], np.cumsum([len(d) // 16 for d in data])))
        first = 0  # of the small blocks that are taken together
        for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            alone = e - s > FEW or weight[e] - weight[s] > HELD
            if first < s and (alone or weight[e] - weight[first] > HELD):
                yield table.slice(first, s - first), iter([_few(data[first:s], number[first:s], cols["key"][first:s], part[first:s])])
                first = s
            if alone:
                yield table.slice(s, e - s), large(data[s:e], int(cols["key"][s]), cols["part"][s:e] if apart[s] else None)
                first = e
        if first < table.num_rows:
            yield table.slice(first), iter([_few(data[first:], number[first:], cols["key"][first:], part[first:])])


def members(met: DataFrame, sets: DataFrame, elements: int = ELEMENTS) -> DataFrame:
    """``met`` with the columns of ``sets`` (node, tail, elements ...), dealt and sorted for verified_blocks()."""
    weight = F.greatest(F.col("size"), F.lit(max(1, elements // MEMBERS)))
    placed = weighed_blocks(met, "key", "node", weight, elements)
    out = placed.join(sets, CLASS)
    return out.repartition(tasks(met), "key", "i", "j").sortWithinPartitions("key", "i", "j", *CLASS)
