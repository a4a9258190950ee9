"""Line dedup: an exact set-similarity self-join of lines, and removal of later matches.

A line's tokens are its distinct words (runs of anything but ASCII white space,
A-Z lower-cased).  Two lines match at a Jaccard similarity of 0.8 or more.  A
line that matches any earlier line, by (doc_id, line), is removed; a line
without words never is.

Lines with the same tokens form a class, and only classes are joined: ordered by
rarity, prefix tokens pick candidates, length, position and bitmap filters thin
them out, and the sets decide (see setjoin).  Each task gives back one row for
each member of a group, however many pairs the group has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK
from .bytewords import Words, words
from .setjoin import BUCKETS, CLASS, ELEMENTS, PACKED, Seen, Sets, candidates, count, count_rows, distinct, members, pack_sets, packed, prefix_rows, rarity, verified_blocks
from .storage import broadcastable, in_batches, materialise


def _lines(w: Words, rank: np.ndarray | None = None) -> tuple[Sets, np.ndarray]:
    """The chunk's lines as sets, and the number of each within its text."""
    line, within = w.lines()
    s = distinct(w.name, w.checks(), line, rank)
    return s, within[s.opens]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: 0 for each line (a: doc, line, class, tag), 1 for word counts from bucket a on."""
    counts = np.zeros(BUCKETS, np.int64)
    names = ["kind", "a", "line", *CLASS, "tag", "counts"]
    for batch in batches:
        doc, tag = batch.column("doc_id"), batch.column("tag")
        for w in words(batch.column("text")):
            count(counts, w.name)
            s, within = _lines(w)
            row = pa.array(w.text[s.opens] + w.first)
            n = s.opens.size
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), doc.take(row), pa.array(within), pa.array(s.node), pa.array(s.tail), tag.take(row), pa.nulls(n, pa.binary())], names)
    parts = count_rows(counts)
    n = parts.num_rows
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(n, np.int32)), parts.column("a"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), parts.column("counts")], names
    )


def _prefixes(batches: Iterator[pa.RecordBatch], rank: np.ndarray, single: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Prefix rows of each class, packed by share, once for a chunk, mostly once for a task."""
    seen = Seen()

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                s, _ = _lines(w, rank)
                yield prefix_rows(s, seen.fresh(s), single, wide=True)

    yield from packed(rows(), shares)


def _elements(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, tail, doc, line, elements) of the given lines."""
    for batch in batches:
        for w in words(batch.column("words")):
            s = distinct(w.name, w.checks(), w.text, rank)
            row = pa.array(w.text[s.opens] + w.first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in (*CLASS, "doc", "line")), pack_sets(s)], [*CLASS, "doc", "line", "elements"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tail, links, doc, line) for each member with a link that is counted in its block; doc, line: the earliest."""
    for rows, pairs in verified_blocks(batches, ("doc", "line")):
        n = rows.num_rows
        links, least = np.zeros(n, np.int64), np.full(n, n)
        for a, b in pairs:
            links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            # Members are in order, so the first link is the earliest.
            np.minimum.at(least, a, b)
            np.minimum.at(least, b, a)
        found = np.flatnonzero(links)
        if found.size:
            own, other = rows.take(pa.array(found)), rows.take(pa.array(least[found]))
            cols = [own.column(c).combine_chunks() for c in CLASS] + [pa.array(links[found])] + [other.column(c).combine_chunks() for c in ("doc", "line")]
            yield pa.RecordBatch.from_arrays(cols, [*CLASS, "links", "doc", "line"])


def matched_lines(docs: DataFrame, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """A row for each line that has words.

    Columns: doc_id, line (from 0), class_doc_id and class_line (first line with
    the same tokens), links (other classes that match this one), match_doc_id and
    match_line (earliest line of those; null without one), removed, tag (a hash
    of the whole text, which tells apart rows that share a doc_id).

    Null text: no lines.  Null doc_id: such rows come before all others, as one
    document.  Rows that share a doc_id are taken as one document; lines that
    then stand at the same place are not earlier than one another.  ``block`` and
    ``elements`` bound the rows and the words that are compared in one piece.
    """
    least = F.lit(-(1 << 63))
    source = docs.select(F.coalesce("doc_id", least).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tag"))
    scan = materialise(in_batches(source, _scan, "kind int, a long, line long, node long, tail int, tag long, counts binary"), "lines", "kind")
    lines = scan.where("kind = 0").select(F.col("a").alias("doc"), "line", *CLASS, "tag")
    rank, single, shares = rarity(scan.where("kind = 1"))

    classes = materialise(lines.groupBy(*CLASS).agg(F.min(F.struct("doc", "line", "tag")).alias("first")).select(*CLASS, "first.*"), "classes")
    rows = in_batches(source.select("text"), partial(_prefixes, rank=rank, single=single, shares=shares), PACKED)
    met = candidates(rows, block)
    active = materialise(met.select(*CLASS).distinct().join(classes, CLASS), "active")

    text = source.select(F.col("doc_id").alias("doc"), "tag", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    # Rows that share a doc_id and a text give a class more than once.
    picked = text.join(broadcastable(active), ["doc", "line", "tag"]).dropDuplicates(CLASS)
    sets = in_batches(picked.select(*CLASS, "doc", F.col("line").cast("long").alias("line"), "words"), partial(_elements, rank=rank), "node long, tail int, doc long, line long, elements binary")
    linked = in_batches(members(met, sets, elements), _verified, "node long, tail int, links long, doc long, line long")
    links = linked.groupBy(*CLASS).agg(F.sum("links").alias("links"), F.min(F.struct("doc", "line")).alias("match"))

    named = classes.drop("tag").withColumnRenamed("doc", "class_doc").withColumnRenamed("line", "class_line").join(links, CLASS, "left")
    # Written, so that both sides of this join are plain shuffles and Spark can split the lines of a common class.
    out = lines.join(materialise(named, "named"), CLASS)
    place, first = F.struct("doc", "line"), F.struct(F.col("class_doc").alias("doc"), F.col("class_line").alias("line"))
    removed = (place > first) | F.coalesce(F.col("match") < first, F.lit(False))
    real = lambda c: F.when(c != least, c)
    return out.select(
        real(F.col("doc")).alias("doc_id"), "line", real(F.col("class_doc")).alias("class_doc_id"), "class_line",
        F.coalesce("links", F.lit(0)).alias("links"), real(F.col("match.doc")).alias("match_doc_id"), F.col("match.line").alias("match_line"), removed.alias("removed"), "tag",
    )


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers ``gone`` has in order: what stands between them, joined."""

    def between(both: Column) -> Column:
        lines = both["lines"]
        bounds = F.concat(F.array(F.lit(-1).cast("long")), both["gone"], F.array(F.size(lines).cast("long")))

        def pieces(edge: Column) -> Column:
            stay = lambda k: F.slice(lines, F.get(edge, k).cast("int") + 2, (F.get(edge, k + 1) - F.get(edge, k) - 1).cast("int"))
            return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(edge) - 2), stay)), "\n")

        return F.get(F.transform(F.array(bounds), pieces), F.lit(0))

    # As variables of array functions the lines are split once, not once for each piece.
    return F.get(F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone"))), between), F.lit(0))


def drop_matched_lines(docs: DataFrame, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; other columns stay, n_chars is counted anew if there.

    Rows without a removed line stay as they are, as do null texts.
    """
    removed = matched_lines(docs, block, elements).where("removed")
    gone = removed.groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.sort_array(F.collect_set("line")).alias("__gone"))
    gone = materialise(gone, "gone")
    joined = docs.join(broadcastable(gone), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tag")), "left")
    out = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__gone"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(docs.columns)
