"""Comparing the members of each group with one another, in bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import tasks
from .storage import broadcastable, materialise

#: Most members of a group that one task is given in one block.
BLOCK = 2048


def weighed_blocks(rows: DataFrame, key: str, member: str, weight: Column, most: int) -> DataFrame:
    """Deal groups of ``key`` out so that every two members meet in a block of bounded weight.

    A group whose rows weigh up to ``most`` together stays one block (``i`` =
    ``j`` = 0).  A heavier one is cut by the hash of ``member`` into parts of about
    that weight, and a block is made for each pair of parts, so each two members
    still meet and no task is given the group as a whole.  Adds ``i``, ``j``: the
    parts of the block, and ``part``: the row's own.
    """
    hot = rows.groupBy(key).agg(F.sum(weight).alias("__w")).where(F.col("__w") > most)
    cut = materialise(hot.select(key, F.ceil(F.col("__w") / most).cast("int").alias("__parts")), "hot")
    if cut.take(1):
        dealt = rows.join(broadcastable(cut), key, "left")
    else:
        dealt = rows.withColumn("__parts", F.lit(1))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = dealt.withColumn("__other", other).withColumn("i", F.least("part", "__other")).withColumn("j", F.greatest("part", "__other"))
    return dealt.drop("__parts", "__other")


def block_groups(rows: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """weighed_blocks() of up to ``block`` rows, dealt to tasks and sorted by block, then member."""
    dealt = weighed_blocks(rows, key, member, F.lit(1), block)
    return dealt.repartition(tasks(rows), key, "i", "j").sortWithinPartitions(key, "i", "j", member)


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("key", "i", "j"), rows: int = 65536) -> Iterator[pa.Table]:
    """Join sorted batches to tables that end where a block ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        cols = [table.column(k).to_numpy() for k in keys]
        same = np.ones(n, bool)
        for c in cols:
            same &= c == c[-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def pairs_by_offset(starts: np.ndarray, n: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs a < b within the runs that begin at ``starts`` that ``keep`` accepts, some at a time.

    Runs are compared at offset 1, then 2 and so on, all of them at once.
    """
    size = np.diff(np.append(starts, n))
    end = np.repeat(starts + size, size)
    rows = np.arange(n)
    live = rows[end - rows > 1]
    offset = 1
    while live.size:
        for at in range(0, live.size, most):
            a = live[at : at + most]
            b = a + offset
            ok = keep(a, b)
            if ok.any():
                yield a[ok], b[ok]
        offset += 1
        live = live[live + offset < end[live]]


class Forest:
    """Links among n rows, kept as the least row that each reaches, however many pairs are added."""

    HELD = 1 << 19

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += a.size
        if self.held > self.HELD:
            self._fold()

    def _fold(self) -> None:
        # Each row hangs under its root, so old roots that are joined carry theirs along.
        a, b = (np.concatenate([self.root[x] for x in side]) if side else np.empty(0, np.int64) for side in (self.a, self.b))
        self.root = forest(a, b, self.root.size)[self.root]
        self.a, self.b, self.held = [], [], 0

    def hung(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hang under another, and that one."""
        self._fold()
        rows = np.flatnonzero(self.root != np.arange(self.root.size))
        return rows, self.root[rows]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least row linked to each row 0..n-1 by the pairs (a, b): linear output for any number of pairs."""
    label = np.arange(n)
    if not a.size:
        return label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return label
        label = new
