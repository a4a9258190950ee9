"""Merkle manifest of a table of documents: a root over all rows, and for each row the proof that it is under it.

A leaf is the SHA-256 of a row's fields, each framed by its length.  The leaves
of a language ascend by doc_id; eight consecutive nodes become one, level by
level, until one is left, the subroot; the subroots, in order of the languages,
become the root in the same way.

The trees are built in aligned blocks of 8 ** 3 nodes.  A task visits a block in
postorder: each visit returns the digest of its subtree, and as it unwinds it
appends the siblings of every child to the leaves below that child.  The blocks'
roots are the nodes of another traversal, again spread over tasks, until each
language has one; and the languages' subroots of one more.  Then the siblings
found higher up are handed down to the blocks of the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import tasks
from .storage import broadcastable, in_batches, materialise

FAN, LEVELS = 8, 3
#: Nodes of a block.
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A node's siblings on one level: the digests before it and those after it, joined.
Path = list[tuple[str, str]]
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: str = "text") -> Column:
    return F.sha2(F.concat(*[framed(F.col(text if f == "text" else f)) for f in FIELDS]), 256)


def tampered() -> Column:
    """The leaf of a row whose text has its A-Z lower-cased, where 3 divides crc32(doc_id); a null doc_id never."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    return F.sha2(F.concat(*[framed(changed if f == "text" else F.col(f)) for f in FIELDS]), 256)


def visit(nodes: list[str], levels: int) -> tuple[str, list[Path]]:
    """Digest of the subtree over ``nodes``, which is ``levels`` high, and each node's siblings, lowest first."""
    paths: list[Path] = [[] for _ in nodes]

    def subtree(level: int, start: int) -> str:
        if not level:
            return nodes[start]
        width = FAN ** (level - 1)
        starts = range(start, min(start + FAN * width, len(nodes)), width)
        children = [subtree(level - 1, s) for s in starts]
        for k, s in enumerate(starts):
            siblings = "".join(children[:k]), "".join(children[k + 1 :])
            for path in paths[s : s + width]:
                path.append(siblings)
        return digest("".join(children))

    return subtree(levels, 0), paths


def height(n: int) -> int:
    """Levels of a block among ``n`` nodes in all: those of a full block, unless all nodes are in it."""
    return min(LEVELS, next(k for k in range(64) if FAN**k >= n))


def fold(node: str, path: Path) -> str:
    """The root that ``node`` and its siblings lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``at``, the place of each row in its group, and ``n``, the rows of the group.

    Rows are range-partitioned by group and order, so a group of any size is
    spread; only the partitions' counts are summed up.
    """
    ranged = nodes.repartitionByRange(tasks(nodes), group, *order).sortWithinPartitions(group, *order)
    # The number of the partition, and in the lower 33 bits that of the row.
    numbered = materialise(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "placed")
    counts = numbered.groupBy(group, "part").agg(F.min("row").alias("first"), F.count("*").alias("held"))
    all_parts, earlier = Window.partitionBy(group), Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("of"), F.col("part").alias("in"), "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(all_parts).alias("n"))
    joined = numbered.join(broadcastable(materialise(counts, "counts")), F.col("part").eqNullSafe(F.col("in")) & F.col(group).eqNullSafe(F.col("of")))
    return joined.withColumn("at", F.col("before") + F.col("row") - F.col("first")).drop("row", "part", "of", "in", "first", "before")


def _blocks(nodes: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row for each aligned block of nodes: the group, the block, n and, in order, the nodes."""
    block = F.floor(F.col("at") / BLOCK).alias("block")
    return nodes.groupBy(group, block).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *fields))).alias("nodes"))


def _roots(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """The root of each block; it is a node among the group's ceil(n / BLOCK)."""
    for batch in batches:
        n = batch.column("n").to_pylist()
        roots = [visit([x["digest"] for x in nodes.as_py()], height(k))[0] for nodes, k in zip(batch.column("nodes"), n, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("block"), pa.array([-(-k // BLOCK) for k in n], pa.int64()), pa.array(roots, pa.string())], [group, "at", "n", "digest"])


def _paths(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """The siblings of each node within its block, and the block's root."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for batch in batches:
        for k in range(batch.num_rows):
            nodes = batch.column("nodes")[k].as_py()
            root, paths = visit([x["digest"] for x in nodes], height(batch.column("n")[k].as_py()))
            size = len(nodes)
            path = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind)
            same = [pa.array([batch.column(c)[k].as_py()] * size, batch.schema.field(c).type) for c in (group, "block")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([x["at"] for x in nodes]), pa.array([x["digest"] for x in nodes]), path, pa.array([root] * size)], [group, "block", "at", "digest", "path", "root"])


def _climb(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """Traverse ``nodes`` (group, at, n, digest) upwards: the nodes with their paths of each round, and the roots (group, digest)."""
    kind = nodes.schema[group].dataType.simpleString()
    rounds, done = [], nodes.where("n = 1").select(group, "digest")
    while True:
        nodes = nodes.where("n > 1")
        blocks = materialise(_blocks(nodes, group, ["digest"]), "blocks")
        if blocks.isEmpty():
            return rounds, done
        found = materialise(in_batches(blocks, lambda b: _paths(b, group), f"`{group}` {kind}, block long, at long, digest string, path {_PATH}, root string"), "paths")
        rounds.append(found.select(group, "at", "block", "path"))
        nodes = materialise(in_batches(blocks, lambda b: _roots(b, group), f"`{group}` {kind}, at long, n long, digest string"), "roots")
        done = done.union(nodes.where("n = 1").select(group, "digest"))


def _handed_down(rounds: list[DataFrame], top: DataFrame, group: str) -> DataFrame:
    """For each node of the lowest round its siblings up to the top; ``top`` (group, path, ...) ends every path.

    Groups without a round of their own have the path of the top at node 0.
    """
    extra = [c for c in top.columns if c not in (group, "path")]
    above = top.select(F.col(group).alias("of"), F.lit(0).cast("long").alias("over"), F.col("path").alias("rest"), *extra)
    for nodes in reversed(rounds):
        # A group whose nodes first appear in this round has its top at node 0, as has one that is done already.
        joined = nodes.join(broadcastable(above), F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("over")))
        made = joined.select(F.col(group).alias("of"), F.col("at").alias("over"), F.concat("path", "rest").alias("rest"), *extra)
        waiting = above.join(nodes.select(F.col(group).alias("known")).distinct(), F.col("of").eqNullSafe(F.col("known")), "left_anti")
        above = materialise(made.unionByName(waiting.select(made.columns)), "handed")
    return above


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf with its proof, folded once more from what its row holds now."""
    for batch in batches:
        for k in range(batch.num_rows):
            nodes, rest = batch.column("nodes")[k].as_py(), [(x["left"], x["right"]) for x in batch.column("rest")[k].as_py()]
            subroot, root = batch.column("subroot")[k].as_py(), batch.column("root")[k].as_py()
            _, paths = visit([x["digest"] for x in nodes], height(batch.column("n")[k].as_py()))
            whole = [path + rest for path in paths]
            folded = [fold(x["now"], path) for x, path in zip(nodes, whole, strict=True)]
            proofs = ["".join(a + b for a, b in path) for path in whole]
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["doc_id"] for x in nodes], pa.int64()), pa.array([x["digest"] for x in nodes]), pa.array([subroot] * n), pa.array([root] * n), pa.array(map(digest, proofs), pa.string()), pa.array(folded), pa.array([f == root for f in folded])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def manifest(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``now`` is the leaf to verify, a column over ``docs``; by default the same
    leaf.  proof_sha256 is the digest of all siblings on the way from the leaf
    to the root, left to right.  verified: the siblings and ``now`` lead to the
    root.

    Null fields have a frame of their own, so that a null text is not an empty
    one.  A null lang is a language, the first; null doc_ids come first.  Rows
    with one doc_id are ordered by their leaf, and equal rows are leaves of their
    own.  Without documents there is no root and no row.  Columns that aren't
    fields of the leaf are ignored.
    """
    leaves = docs.select("doc_id", "lang", leaf().alias("digest"), (leaf() if now is None else now).alias("now"), F.monotonically_increasing_id().alias("turn"))
    placed = _placed(materialise(leaves, "leaves"), "lang", ["doc_id", "digest", "turn"])
    blocks = materialise(_blocks(placed, "lang", ["doc_id", "digest", "now"]), "leaf-blocks")
    above = materialise(in_batches(blocks.select("lang", "block", "n", "nodes"), lambda b: _roots(b, "lang"), "lang string, at long, n long, digest string"), "roots")
    rounds, subroots = _climb(above, "lang")

    # The subroots are nodes of one group, named 0.
    subroots = materialise(subroots.withColumn("all", F.lit(0)), "subroots")
    nodes = materialise(_placed(subroots, "all", ["lang"]), "languages")
    upper, root = _climb(nodes.select("all", "at", "n", "digest"), "all")
    whole = _handed_down(upper, root.select("all", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root")), "all")
    top = nodes.join(broadcastable(materialise(whole, "top")), F.col("at") == F.col("over")).select("lang", F.col("rest").alias("path"), F.col("digest").alias("subroot"), "root")

    down = broadcastable(materialise(_handed_down(rounds, materialise(top, "top"), "lang"), "down"))
    met = blocks.join(down, F.col("lang").eqNullSafe(F.col("of")) & (F.col("block") == F.col("over"))).select("n", "nodes", "rest", "subroot", "root")
    return in_batches(met, _proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
