"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence (text up to ``.``, ``!``, ``?`` or a line end) has the distinct features
of its words, hashed: each word, and its beginnings of 4 to 8 bytes if it goes on
after them, so that inflected words are known by their stems.  With non-negative weights w and z the sum over its
words, its score is ``p = (s(b + z) - s(b)) / (1 - s(b))``, s the logistic
function: no evidence, no score, however many sentences a text has.  A document
is toxic if any sentence is, or by a leak, one small number for all documents:
``1 - (1 - leak) * product(1 - p)``.  Weights and leak are learned from document
labels by proximal gradient steps with an L1 penalty, which leaves the few words
that tell.  As the leak alone never makes a document toxic, each toxic one has a
sentence to show for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ALPHANUMERIC, Words, mix, names_of_beginnings, words
from .storage import in_batches

#: The model is fitted on at most so many labelled documents, by hash of the doc_id, and so many characters of them;
#: labelled documents of over TRAIN_LONGEST characters are left out.
TRAIN_DOCUMENTS, TRAIN_CHARACTERS, TRAIN_LONGEST = 10_000, 32_000_000, 320_000
#: The leak is at most this.
LEAK = 0.2
BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
BASE = -4.0

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class Model:
    weight: np.ndarray
    leak: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sentences(w: Words) -> np.ndarray:
    """For each word its sentence, counted over the chunk's texts."""
    if not w.start.size:
        return np.empty(0, np.int64)
    return np.cumsum(_ENDS[w.data], dtype=np.int64)[w.start] + w.text


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if x.size else np.empty(0, np.int64)


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word in a table of its features, and the table: the word's own first, 0 where one is missing."""
    unique, at, row = np.unique(w.name, return_index=True, return_inverse=True)
    table = np.zeros((unique.size, 1 + len(BEGINNINGS)), np.int64)
    table[:, 0] = unique >> np.uint64(64 - BITS)
    length = w.end[at] - w.start[at]
    for k, name in enumerate(names_of_beginnings(w, at, BEGINNINGS), 1):
        table[:, k] = np.where(length > BEGINNINGS[k - 1], mix(name + np.uint64(k)) >> np.uint64(64 - BITS), 0)
    return row, table


def _distinct(group: np.ndarray, row: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and feature of the words, once for a group; ``table`` may have zeros, which count not at all."""
    feature = table[row]
    keep = feature > 0
    both = np.unique((np.repeat(group, keep.sum(1)) << BITS) | feature[keep])
    return both >> BITS, both & ((1 << BITS) - 1)


def _tell(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Features in five documents or more, and at least twice as common in toxic ones as in others."""
    counts = np.zeros((2, 1 << BITS))
    for w in words(texts, ALPHANUMERIC):
        doc, feature = _distinct(w.text, *_features(w))
        for k in (0, 1):
            counts[k] += np.bincount(feature[toxic[doc + w.first] == k], minlength=1 << BITS)
    rate = counts / np.array([[len(toxic) - toxic.sum()], [toxic.sum()]])
    return (counts.sum(0) >= 5) & (rate[1] >= 2 * rate[0])


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 150, l1: float = 2e-4, step: float = 0.1) -> Model:
    """Learn from documents' labels (0 or 1); the texts are passed over twice, to choose features and to gather them."""
    size = 1 << BITS
    if not len(toxic) or not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros(size, np.float32), min(LEAK, float((toxic.sum() + 1) / (len(toxic) + 2))))
    tell = _tell(texts, toxic)
    feature, sentence, owner = [], [], []
    base = 0
    for w in words(texts, ALPHANUMERIC):
        row, table = _features(w)
        told = np.where(tell[table], table, 0)
        hits = np.flatnonzero(told.any(1)[row])
        every = _sentences(w)
        s, f = _distinct(every[hits], row[hits], told)
        runs = _runs(every[hits])
        # Sentences are numbered anew, those with a feature only.
        sentence.append(np.searchsorted(every[hits][runs], s) + base)
        owner.append(w.text[hits][runs] + w.first)
        base += runs.size
        feature.append(f)
    feature, sentence, owner = (np.concatenate(x) for x in (feature, sentence, owner))
    n = len(toxic)
    tells, feature = np.unique(feature, return_inverse=True)
    weight, tilt, most = np.full(tells.size, 0.1), -3.0, float(np.log(LEAK / (1 - LEAK)))
    state = [[np.zeros(tells.size), np.zeros(tells.size)], [np.zeros(1), np.zeros(1)]]
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weight[feature], minlength=base)
        log_not = np.bincount(owner, np.logaddexp(0, BASE) - np.logaddexp(0, BASE + z), minlength=n) - np.logaddexp(0, tilt)
        clean = np.clip(np.exp(log_not), 1e-12, 1 - 1e-6)
        # Slope of the loss along log(1 - score).
        slope = np.where(toxic == 1, clean / (1 - clean), -1.0) / n
        by_sentence = -slope[owner] * _sigmoid(BASE + z)
        grads = (np.bincount(feature, by_sentence[sentence], minlength=tells.size), np.array([(-slope * _sigmoid(tilt)).sum()]))
        for k, (g, (m, v)) in enumerate(zip(grads, state, strict=True)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = step / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            move = rate * m / (1 - 0.9**t)
            if k == 0:
                weight = np.maximum(weight - move - rate * l1, 0)
            else:
                tilt = min(most, tilt - float(move[0]))
    out = Model(np.zeros(size, np.float32), float(_sigmoid(tilt)))
    out.weight[tells] = weight
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a sample of the labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample is bounded by TRAIN_DOCUMENTS, TRAIN_LONGEST and TRAIN_CHARACTERS,
    in the order of a hash of the doc_id; a document that would pass the bound of
    characters is left out, and those after it are not.  Rows without a label or a
    doc_id are not used; a doc_id labelled twice takes the larger label; of
    different texts with one doc_id the one with the least hash is learned from.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    # At most TRAIN_DOCUMENTS rows; lengths first, so that no text is moved that isn't learned from.
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.struct(F.xxhash64(text).alias("tie"), F.length(text).alias("n")).alias("size")).join(F.broadcast(some), "doc_id")
    found = sized.groupBy("doc_id").agg(F.min("size").alias("size"), F.first("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, total = {}, 0
    for r in found:
        if r.size.n <= TRAIN_LONGEST and total + r.size.n <= TRAIN_CHARACTERS:
            chosen[r.doc_id] = (r.doc_id, r.size.tie, float(r.toxic > 0))
            total += r.size.n
    # As an Arrow table, for which no Python workers are begun.
    kinds = {"doc_id": pa.int64(), "tie": pa.int64(), "toxic": pa.float64()}
    table = pa.table({c: pa.array([row[k] for row in chosen.values()], kind) for k, (c, kind) in enumerate(kinds.items())})
    picked = F.broadcast(spark.createDataFrame(table))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).join(picked, ["doc_id", "tie"]).dropDuplicates(["doc_id"])
    sample = rows.select("doc_id", "text", "toxic").toArrow().sort_by("doc_id").combine_chunks()
    if not sample.num_rows:
        return fit(pa.array([], pa.string()), np.empty(0))
    return fit(sample.column("text").chunk(0), sample.column("toxic").to_numpy())


def _chunk_scores(w: Words, texts: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; of each sentence with evidence its number, text and score, and whether it offends:
    at 0.5 or more, or as the highest of a toxic text."""
    row, table = _features(w)
    log_not = np.full(texts, np.log1p(-model.leak))
    told = np.where(model.weight[table] > 0, table, 0)
    hits = np.flatnonzero(told.any(1)[row])
    if not hits.size:
        none = np.empty(0, np.int64)
        return -np.expm1(log_not), none, none, np.empty(0), np.empty(0, bool)
    every = _sentences(w)[hits]
    sentence, feature = _distinct(every, row[hits], told)
    runs = _runs(sentence)
    z = np.add.reduceat(model.weight[feature].astype(float), runs)
    text = w.text[hits[np.searchsorted(every, sentence[runs])]]
    gone = np.logaddexp(0, BASE) - np.logaddexp(0, BASE + z)
    log_not += np.bincount(text, gone, minlength=texts)
    score, p = -np.expm1(log_not), -np.expm1(gone)
    most = np.zeros(texts)
    np.maximum.at(most, text, p)
    return score, sentence[runs], text, p, (p >= 0.5) | ((score[text] >= 0.5) & (p == most[text]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, offending = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for w in words(batch.column("text"), ALPHANUMERIC):
            texts = w.offsets.size - 1
            score, _, text, _, offends = _chunk_scores(w, texts, model)
            scores[w.first : w.first + texts] = score
            offending[w.first : w.first + texts] = np.bincount(text[offends], minlength=texts)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array(offending)], [*batch.schema.names[:-1], "score", "offending_sentences"])


def _locate(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc_id")
        for w in words(batch.column("text"), ALPHANUMERIC):
            _, sentence, text, p, offends = _chunk_scores(w, w.offsets.size - 1, model)
            every = _sentences(w)
            out: list[tuple] = []
            for k in np.flatnonzero(offends).tolist():
                own, stop = np.searchsorted(every, [sentence[k], sentence[k] + 1])
                t = int(text[k])
                raw, at = w.data[w.offsets[t] : w.offsets[t + 1]].tobytes(), int(w.offsets[t])
                begin, end = len(raw[: w.start[own] - at].decode()), len(raw[: w.end[stop - 1] - at].decode())
                out.append((doc[t + w.first].as_py(), begin, end, float(p[k])))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "start", "end", "score"])


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the doc_id as text, mod 5, is 0; so is a null one, which is never learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and offending_sentences of the whole text.

    A sentence offends at 0.5 or more, or if it is the highest of a text with a
    score of 0.5 or more.  A null text is an empty one, and its score is the leak.
    """
    names = [c for c in docs.columns if c not in ("score", "offending_sentences")]
    kept = docs.select(*names)
    source = kept.withColumn("__whole", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
        def renamed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.rename_columns([*[f"c{i}" for i in range(b.num_columns - 1)], "text"])

        yield from (b.rename_columns([*names, "score", "offending_sentences"]) for b in _score(renamed(), model))

    return in_batches(source, run, kept.schema.add("score", "double").add("offending_sentences", "long"))


def offending(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score) of the sentences that offend, in code points from first to last word."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(source, partial(_locate, model=model), "doc_id long, start long, end long, score double")
