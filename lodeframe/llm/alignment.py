"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

The ends of either tokenizer's tokens are bits over the bytes of a text, packed
in 64-bit words.  The bits of both, ANDed, are the shared cuts; counting bits up
to a cut gives the number of tokens before it, so each cut becomes a range of
tokens on either side.  All tokens between two cuts form a group, and every pair
of a group, one token from each side, is a link.

Both tokenizers end a token wherever a blank follows something that isn't white
space, so a text is cut there, and each distinct word is encoded and aligned
once; a worker keeps the words of its last packs.  Documents go by packs of a few
megabytes.  A pack tells Spark its distinct id pairs and how many of its
documents hold each; sums over all packs are the corpus-wide counts, which come
back to the packs as one row for each pair that a pack holds.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcastable, in_batches, materialise

#: Bytes of text of a pack; a longer text is a pack by itself.
PACK = 8 << 20
#: Words that a worker keeps, and links of theirs.
WORDS, LINKS = 1 << 18, 1 << 22
#: Links expanded at once.
SLAB = 1 << 20

_SPACE = r" \t-\r\x85\xa0  -     　"
_OTHER = _SPACE.removeprefix(" ")
#: White space and what follows, up to a blank.  Other white space does not end a word.
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{_OTHER}][{_SPACE}]*[^{_SPACE}]+)*(?:[{_OTHER}][{_SPACE}]*\\Z)?|[{_SPACE}]+")
_BLANK = "▁"


def _byte_of() -> dict[str, int]:
    """Byte-level alphabets write printable Latin-1 characters as themselves and other bytes as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers: ids of words, and the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        # Strings of special tokens in a text are plain text.
        self.a.encode_special_tokens = True
        byte = _byte_of()
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(names.values()))
        for name, k in names.items():
            self.bytes_a[k] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        #: Whether no token of either crosses the place before a blank that follows something else.
        self.apart = made["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.apart &= not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def words(self, text: str) -> list[str]:
        """Parts of a blank and ``text`` that are encoded each by itself."""
        return _WORD.findall(" " + text) if self.apart else [" " + text]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of words, each of which begins with a blank; the second tokenizer adds that blank itself."""
        ids_a = [e.ids for e in self.a.encode_batch(words, add_special_tokens=False)]
        # Before an empty text no blank is set.
        alone = [self.b.piece_to_id(_BLANK)]
        return ids_a, [x or alone for x in self.b.encode([w[1:] for w in words], num_threads=1)]


_pairs: dict[tuple[str, str], Pair] = {}


def _bits(ends: np.ndarray, size: int) -> np.ndarray:
    """``size`` bits in 64-bit words, those at ``ends`` set."""
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[ends] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _ranks(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set bits up to and at each place."""
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - at % 64).astype(np.uint64)
    return before[at // 64] + np.bitwise_count(bits[at // 64] & upto)


def shared_cuts(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side up to each shared cut, from the sizes of tokens that cover the same bytes."""
    total = int(size_a.sum())
    a, b = _bits(np.cumsum(size_a) - 1, total), _bits(np.cumsum(size_b) - 1, total)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return _ranks(a, cuts), _ranks(b, cuts)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` over each."""
    if not key.size:
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[head], np.add.reduceat(n[order], head)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``size`` of them) of all runs, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def links(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id pair, number of links) in order of owner and pair; ``of`` is the owner of each group.

    An id pair is the first id in the upper, the second in the lower 32 bits.
    Links are expanded a bounded number at a time.  Within one larger group equal
    ids are counted first, so that long repeats don't multiply.
    """
    from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
    held_a, held_b = to_a - from_a, to_b - from_b
    each = held_a * held_b
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(owner: np.ndarray, pair: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))) if owner.size else np.empty(0, np.int64)
        parts.append((owner[head], pair[head], np.add.reduceat(n[order], head) if head.size else n[:0]))

    def compact() -> None:
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        parts.clear()
        add(*merged)

    small = np.flatnonzero(each <= 1024)
    edges = np.unique(np.append(np.searchsorted(np.cumsum(each[small]), np.arange(SLAB, int(each[small].sum()), SLAB)), small.size))
    for low, high in zip(np.concatenate(([0], edges[:-1])), edges, strict=True):
        g = small[low:high]
        a = _runs(from_a[g], held_a[g])
        width = np.repeat(held_b[g], held_a[g])
        b = _runs(np.repeat(from_b[g], held_a[g]), width)
        add(np.repeat(of[g], each[g]), (ids_a[np.repeat(a, width)] << 32) | ids_b[b], np.ones(b.size, np.int64))
    waiting = 0
    for g in np.flatnonzero(each > 1024).tolist():
        (a, n_a), (b, n_b) = (np.unique(x, return_counts=True) for x in (ids_a[from_a[g] : to_a[g]], ids_b[from_b[g] : to_b[g]]))
        step = max(1, SLAB // b.size)
        for k in range(0, a.size, step):
            pair = ((a[k : k + step, None] << 32) | b[None, :]).ravel()
            parts.append((np.full(pair.size, of[g]), pair, (n_a[k : k + step, None] * n_b[None, :]).ravel()))
            waiting += pair.size
            if waiting > 4 * SLAB:
                compact()
                waiting = 0
    compact()
    return parts[0]


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids, right-aligned in ten columns, and which of them count."""
    place = 10 ** np.arange(9, -1, -1)
    return (ids[:, None] // place % 10 + 48).astype(np.uint8), (ids[:, None] >= place) | (place == 1)


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, of: np.ndarray, owners: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each owner."""
    held_a, held_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    first = np.cumsum(held_a + held_b) - held_a - held_b
    ids = np.empty(ids_a.size + ids_b.size, np.int64)
    ids[_runs(first, held_a)], ids[_runs(first + held_a, held_b)] = ids_a, ids_b
    after = np.full(ids.size, ord(","), np.uint8)
    after[first + held_a - 1] = ord("|")
    after[first + held_a + held_b - 1] = ord(";")
    digits, counted = _digits(ids)
    text = np.concatenate((digits, after[:, None]), axis=1)[np.concatenate((counted, np.ones((ids.size, 1), bool)), axis=1)].tobytes().decode()
    length = counted.sum(1) + 1
    ends = np.cumsum(np.bincount(np.repeat(of, held_a + held_b), length, minlength=owners)).astype(np.int64).tolist()
    return [text[s : e - 1] for s, e in zip([0, *ends], ends, strict=False)]


@dataclass
class Known:
    """Words that a worker has aligned: their number, counts, groups as text, and links."""

    number: dict[str, int] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)
    #: Tokens of either side, groups, links, and 1 if the tokens' bytes aren't the word's.
    counts: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int64))
    start: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pair: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def learn(self, pair: Pair, words: list[str]) -> None:
        """Align words that aren't known."""
        ids_a, ids_b = pair.encode(words)
        good = [b"".join(map(pair.bytes_a.__getitem__, a)) == (raw := w.encode()) == b"".join(map(pair.bytes_b.__getitem__, b)) for w, a, b in zip(words, ids_a, ids_b, strict=True)]
        counts = np.zeros((len(words), 5), np.int64)
        counts[:, 4] = np.logical_not(good)
        kept = np.flatnonzero(good)
        text = [""] * len(words)
        size = np.zeros(len(words), np.int64)
        if kept.size:
            flat = [np.fromiter((i for k in kept for i in x[k]), np.int64) for x in (ids_a, ids_b)]
            n_a, n_b = (np.fromiter((len(x[k]) for k in kept), np.int64, kept.size) for x in (ids_a, ids_b))
            # A word ends where tokens of both end, so that all words can be cut at once.
            to_a, to_b = shared_cuts(pair.size_a[flat[0]], pair.size_b[flat[1]])
            of = np.searchsorted(np.cumsum(n_a), to_a)
            each = np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0)
            linked = np.zeros(kept.size, np.int64)
            np.add.at(linked, of, each)
            counts[kept, :4] = np.stack((n_a, n_b, np.bincount(of, minlength=kept.size), linked), axis=1)
            for k, t in zip(kept.tolist(), groups_text(*flat, to_a, to_b, of, kept.size), strict=True):
                text[k] = t
            owner, pairs, times = links(*flat, to_a, to_b, of)
            size[kept] = np.bincount(owner, minlength=kept.size)
            start = self.pair.size + np.cumsum(size) - size
            self.pair, self.times = np.concatenate((self.pair, pairs)), np.concatenate((self.times, times))
        else:
            start = np.zeros(len(words), np.int64)
        self.number.update((w, len(self.text) + k) for k, w in enumerate(words))
        self.text += text
        self.counts = np.concatenate((self.counts, counts))
        self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))

    def full(self) -> bool:
        return len(self.text) > WORDS or self.pair.size > LINKS


_known: dict[tuple[str, str], Known] = {}

_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PACK = f"pack long, docs array<struct<{', '.join(f.replace(' ', ':') for f in _DIGESTS.split(', '))}>>, pairs array<long>, held array<int>, cells binary"
CODEC = "zstd"


def align(pair: Pair, known: Known, ids: list, texts: list[str]) -> tuple[list[dict], np.ndarray, np.ndarray, bytes]:
    """Of a pack: a row for each document, distinct id pairs, how many documents hold each, and the cells.

    Cells say how often each document has each pair: the number of cells of each
    document, then of all cells the place of the pair, then the times.
    """
    words = [pair.words(t) if t else [] for t in texts]
    new = dict.fromkeys(w for ws in words for w in ws if w not in known.number)
    if new:
        known.learn(pair, list(new))
    numbers = [list(map(known.number.__getitem__, ws)) for ws in words]
    size = np.array([len(x) for x in numbers], np.int64)
    flat = np.fromiter((x for n in numbers for x in n), np.int64, int(size.sum()))
    ends = np.cumsum(size)
    totals = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(known.counts[flat], axis=0)))
    sums = totals[ends] - totals[ends - size]
    sums[sums[:, 4] > 0] = 0
    rows = []
    for k, (doc, ns) in enumerate(zip(ids, numbers, strict=True)):
        text = ";".join(map(known.text.__getitem__, ns)) if sums[k, 0] else ""
        rows.append({"doc_id": doc, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums[k, :4].tolist(), strict=True)), "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if text else ""})
    # Words of one document are counted before their links are expanded.
    document = np.repeat(np.arange(size.size), size)
    some = sums[document, 0] > 0
    key, times = _summed(document[some] * len(known.text) + flat[some], np.ones(int(some.sum()), np.int64))
    document, word = (key // max(1, len(known.text)), key % max(1, len(known.text)))
    at = _runs(known.start[word], known.size[word])
    pairs, place = np.unique(known.pair[at], return_inverse=True)
    key, times = _summed(np.repeat(document, known.size[word]) * max(1, pairs.size) + place, known.times[at] * np.repeat(times, known.size[word]))
    place = key % max(1, pairs.size)
    cells = np.bincount(key // max(1, pairs.size), minlength=size.size).astype("<i8").tobytes() + place.astype("<i4").tobytes() + times.astype("<i8").tobytes()
    return rows, pairs, np.bincount(place, minlength=pairs.size), cells


def _packs(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    pair = _pairs.setdefault((a, b), None) or Pair(a, b)
    _pairs[a, b] = pair
    schema = pa.schema([("pack", pa.int64()), ("docs", pa.list_(pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _DIGESTS.split(", ")]))), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("cells", pa.binary())])
    number, codec = TaskContext.get().partitionId() << 33, pa.Codec(CODEC)

    def done(ids: list, texts: list[str]) -> pa.RecordBatch:
        known = _known.setdefault((a, b), Known())
        if known.full():
            known = _known[a, b] = Known()
        rows, pairs, held, cells = align(pair, known, ids, texts)
        packed = len(cells).to_bytes(8, "little") + codec.compress(cells, asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((number, rows, pairs, held, packed), schema, strict=True)], schema=schema)

    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        lengths = batch.column("bytes").to_pylist()
        for doc, text, length in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), lengths, strict=True):
            if texts and size + length > PACK:
                yield done(ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(doc)
            texts.append(text)
            size += length
    if texts:
        yield done(ids, texts)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(packs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one pack with sums over their links of the pairs' corpus-wide counts."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    docs = packs.column("docs").combine_chunks().flatten()
    raw = packs.column("cells")[0].as_py()
    cells = pa.Codec(CODEC).decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    each = np.frombuffer(cells, "<i8", len(docs))
    total = int(each.sum())
    place, times = np.frombuffer(cells, "<i4", total, 8 * each.size), np.frombuffer(cells, "<i8", total, 8 * each.size + 4 * total)
    order = np.argsort(found.column("place").to_numpy())
    ends = np.cumsum(each)
    cols = {c: docs.field(c) for c in names if c not in ("n_best", "count_sum")}
    for name, of in (("n_best", "best"), ("count_sum", "documents")):
        value = found.column(of).to_numpy()[order].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(value[place] * times))) if total else np.zeros(1, np.int64)
        cols[name] = pa.array(sums[ends] - sums[ends - each], pa.int64())
    return pa.table([cols[c] for c in names], names)


def aligned_packs(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Packs of documents with their id pairs, written once; texts are not kept."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("bytes"))
    return materialise(in_batches(source, lambda x: _packs(x, a, b), _PACK), "packs")


def pair_counts(packs: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents each id pair is linked, and whether no pair with its first id is in more."""
    told = packs.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = told.groupBy("pair").agg(F.sum("held").alias("documents"))
    # No more rows to a first id than the second tokenizer has ids.
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "documents", (F.col("documents") == most).alias("best"))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document: n_a and n_b tokens of the tokenizers ``a`` and ``b``, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is the file of a byte-level tokenizer, ``b`` of a sentence-piece model;
    a blank is set before the text, by ``b`` itself.  n_best counts the links whose
    id pair is linked in as many documents as any pair with its first id;
    count_sum adds up, over the links, in how many documents their pair is linked.

    Null and empty texts, and those whose tokens' bytes aren't the text's, have
    no tokens: zeros and an empty groups_sha256.  Rows that share a doc_id, and
    equal rows, are documents of their own.  Without documents there is no row.
    Columns but doc_id and text are ignored.

    A pack's row for each pair meets the counts by a broadcast if their bytes
    allow, else by a shuffle; then by pack its documents.
    """
    packs = aligned_packs(docs, a, b)
    counts = broadcastable(materialise(pair_counts(packs), "pair-counts"))
    wanted = packs.select("pack", F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(counts, "pair").select(F.col("pack").alias("of"), "place", "documents", "best")
    return packs.select("pack", "docs", "cells").groupBy("pack").cogroup(found.groupBy("of")).applyInArrow(_weighed, _RESULT)
