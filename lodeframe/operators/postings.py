"""A text index on disk: posting lists of spans of documents, in blocks of neighbours whose greatest weights bound a search.

Documents are dealt to spans of some SPAN bytes of text by a hash of the key.  In
a span they are numbered so that those with the same weightiest token stand
together, and BLOCK neighbours form a block.  A posting row holds, for a token and
a span, the numbers of the documents that have it, how often they do, and its factor
``lift``; with the norms that stand beside the keys of the span this gives weights:
the token's share of the document's unit vector.  Rows are dealt to folders by a hash of the
token and sorted by token, so that a search reads the folders and row groups of
its tokens.

A search brings the rows of its tokens together by span.  There it adds up, for
each query and block, what its tokens could give at most; scores the few most
promising blocks of each query; and then only those blocks whose bound reaches the
k-th score found.  No document that belongs to the best ``k`` of the span can be in
another block, and the best ``k`` of all are among those of the spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, cjk_tokens, lowered, token_weight, tokens
from .retrieval import COVERED, best
from .written import scratch, written

#: Documents of a block, bytes of text of a span, folders of tokens, and blocks a query that are scored first for each of its k results.
BLOCK, SPAN, FOLDERS, FIRST = 8, 8 << 20, 64, 4
#: Bytes that a document counts besides its text.
ROW = 64
#: Bounds are raised by this much, as sums round.
MARGIN = 1e-9
#: Bytes up to which the asked tokens are broadcast, and spans whose rows of a folder make a file.
SMALL, TOGETHER = 16 << 20, 128
_COLUMNS = "span int, token string, n long, lift double, held array<int>, tfs array<int>, keys array<{}>, norms array<double>"
#: Where the keys of the spans stand, and the numbers that a span has for its documents.
KEYS, NUMBERS = -1, 1 << 32


def _folder(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FOLDERS)).cast("int")


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(table[name]).to_numpy()


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _rank(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _counted(table: pa.Table) -> pa.Table:
    """One row (span, tokens, n, docs, tfs, keys) of the (span, key, low, pieces) of one span; documents are numbered by the places of their keys.

    The tokens are those of tokens(): a text's words are found here, by Arrow.
    Spark checks the size of a batch at each row, which for lists takes as long as
    the batch has rows; so the lists of a span go to and fro as one.
    """
    table = table.combine_chunks()
    keys = table["key"].chunk(0).dictionary_encode(null_encoding="encode")
    lists = pc.split_pattern_regex(table["low"].chunk(0), f"[^{WORD}]+"), table["pieces"].chunk(0)
    words = pa.concat_arrays([pc.list_flatten(x) for x in lists])
    at, some = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]), pc.not_equal(words, "")
    words, doc = words.filter(some).dictionary_encode(), keys.indices.to_numpy()[at[some.to_numpy(zero_copy_only=False)]]
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    pairs, tfs = np.unique(_rank(order)[words.indices.to_numpy()].astype(np.int64) * len(keys.dictionary) + doc, return_counts=True)
    n = np.bincount(pairs // len(keys.dictionary), minlength=len(order))
    one = {
        "tokens": words.dictionary.take(pa.array(order)), "n": pa.array(n, pa.int64()), "docs": pa.array(pairs % len(keys.dictionary), pa.int32()),
        "tfs": pa.array(tfs, pa.int32()), "keys": keys.dictionary,
    }
    return pa.table({"span": table["span"][:1], **{c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in one.items()}})


def _placed(counted: pa.Table, lifted: pa.Table) -> pa.Table:
    """(span, token, n, lift, held, tfs, keys, norms) of one span from what _counted() gives and the factor (token, lift) of each of its tokens."""
    span, (held, keys) = counted["span"][0], (counted.combine_chunks()[c].chunk(0).flatten() for c in ("tokens", "keys"))
    lifted, n = lifted.take(pc.sort_indices(lifted["token"])), _flat(counted, "n")  # the turn of the tokens that are held
    doc, row = _flat(counted, "docs"), np.repeat(np.arange(len(n)), n)
    tf, lift = _flat(counted, "tfs"), lifted["lift"].to_numpy()
    value = tf * lift[row]
    norm = np.sqrt(np.bincount(doc, value * value, len(keys)))
    # The weightiest token of each document tells where it stands.
    first = np.full(len(keys), -1)
    by_value = np.lexsort((row, value, doc))
    first[doc[by_value]] = row[by_value]
    stand = np.flatnonzero((first >= 0) & keys.is_valid().to_numpy(zero_copy_only=False))
    stand = stand[np.lexsort((_rank(pc.array_sort_indices(keys).to_numpy())[stand], first[stand]))]
    number = np.full(len(keys), -1)
    number[stand] = np.arange(len(stand))
    at = np.lexsort((number[doc], row))
    at = at[number[doc[at]] >= 0]
    n = np.bincount(row[at], minlength=len(n))
    has = n > 0
    columns = {
        "token": held.filter(pa.array(has)), "n": pa.array(n[has], pa.int64()), "lift": pa.array(lift[has]),
        "held": _lists(n[has], number[doc[at]], pa.int32()), "tfs": _lists(n[has], tf[at], pa.int32()),
    }
    own = {"keys": keys.take(pa.array(stand)), "norms": pa.array(norm[stand])}
    own = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in own.items()}
    rows = pa.table({"span": pa.repeat(span, has.sum()), **columns, **{c: pa.nulls(has.sum(), x.type) for c, x in own.items()}})
    return pa.concat_tables([rows, pa.table({"span": pa.repeat(span, 1), **{c: pa.nulls(1, x.type) for c, x in columns.items()}, **own})])


def build(docs: DataFrame, path: str | None = None, key: str = "key", text: str = "text") -> TextIndex:
    """Write the index of ``docs`` under ``path``, by default a new folder of the shared scratch.

    ``terms`` (token, df, idf), ``keys`` (key, norm, block) and ``postings``
    (token, span, n, lift, held, tfs) are tables of their own.  Null and empty
    texts count as documents and have no postings; keys are distinct.
    """
    spark = docs.sparkSession
    path = path or f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    n, size = own.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW)).first()
    spans = max(1, -(-(size or 0) // SPAN))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Texts are shuffled, and their tokens are counted where they lie; a span is one group.
    dealt = own.withColumn("span", F.pmod(F.xxhash64("key"), F.lit(spans)).cast("int")).repartition(max(parts, 2 * spans), "span")
    split = dealt.select("span", "key", lowered("text").alias("low"), cjk_tokens("text").alias("pieces"))
    counts = written(split.groupBy("span").applyInArrow(_counted, f"span int, tokens array<string>, n array<long>, docs array<int>, tfs array<int>, keys array<{kind}>"), "counts")
    met = counts.select("span", F.explode(F.arrays_zip("tokens", "n")).alias("t")).select("span", F.col("t.tokens").alias("token"), F.col("t.n").alias("n"))
    terms = met.groupBy("token").agg(F.sum("n").alias("df")).select("token", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    terms.sort("token").write.parquet(f"{path}/terms")
    # Each span is told the factors of its tokens.
    lift = spark.read.parquet(f"{path}/terms").select("token", (F.col("idf") * token_weight("token")).alias("lift"))
    lifted = counts.select("span", F.explode("tokens").alias("token")).join(lift, "token").select(F.col("span").alias("span"), F.col("token").alias("token"), "lift")
    placed = counts.groupBy("span").cogroup(lifted.groupBy("span")).applyInArrow(_placed, _COLUMNS.format(kind))
    # Tokens of one folder lie together, those of many spans in several files.
    folder = F.when(F.col("token").isNull(), KEYS).otherwise(_folder("token"))
    rows = placed.withColumn("folder", folder).repartition(parts, "folder", F.pmod("span", F.lit(-(-spans // TOGETHER)))).sortWithinPartitions("folder", "token", "span")
    rows.write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
    one = _rows(spark, path, kind).where(F.col("folder") == KEYS).select("span", F.posexplode(F.arrays_zip("keys", "norms")).alias("doc", "d"))
    one.select(F.col("d.keys").alias("key"), F.col("d.norms").alias("norm"), F.floor((F.col("span").cast("long") * NUMBERS + F.col("doc")) / BLOCK).alias("block")).write.parquet(f"{path}/keys")
    return TextIndex(spark, path)


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    # Without a token there is no file that tells the columns.
    return spark.read.schema(f"{_COLUMNS.format(kind)}, folder int").parquet(f"{path}/postings")


class _Span:
    """The posting rows of one span whose tokens are asked for, as arrays."""

    def __init__(self, rows: pa.Table, norms: np.ndarray) -> None:
        rows = rows.take(pc.sort_indices(rows["token"])).combine_chunks()  # sums go in the same turn everywhere
        self.tokens, self.doc, n = rows["token"], _flat(rows, "held"), pc.list_value_length(rows["held"]).to_numpy()
        row, block = np.repeat(np.arange(len(n)), n), self.doc // BLOCK
        self.weight = _flat(rows, "tfs") * rows["lift"].to_numpy()[row] / norms[self.doc]
        # Heads: the part of a row that stands in one block.
        self.start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
        self.n = np.diff(np.r_[self.start, len(row)])
        self.top, self.block = np.maximum.reduceat(self.weight, self.start), block[self.start]
        self.heads = np.searchsorted(row[self.start], np.arange(len(n) + 1))
        self.docs, self.blocks = self.doc.max() + 1, block.max() + 1
        asks = rows["asks"].chunk(0)
        query, self.share, self.of = asks.flatten().flatten()
        query, self.row = query.dictionary_encode(), pc.list_parent_indices(asks).to_numpy()
        self.queries, code = query.dictionary, query.indices.to_numpy()
        self.share, self.of = self.share.to_numpy(), self.of.to_numpy()
        self.asks = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code, minlength=len(self.queries)))[:-1])

    def search(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each query its number, documents and their scores, and its heads and whether they were scored."""
        for query, asks in enumerate(self.asks):
            rows, of = self.row[asks], self.of[asks[0]]
            sizes = self.heads[rows + 1] - self.heads[rows]
            head, share = _ranges(self.heads[rows], sizes), np.repeat(self.share[asks], sizes)
            block = self.block[head]
            hits = np.bincount(block, minlength=self.blocks)
            bound = np.bincount(block, share * self.top[head], self.blocks) * (1 - COVERED + COVERED * hits / of) + MARGIN
            bound[hits == 0] = -1
            opened, score = np.zeros(self.blocks, bool), np.zeros(self.docs)
            turn = np.argsort(-bound, kind="stable")[: FIRST * k]
            # The most promising blocks, then all others that the k-th score found lets in.
            while len(turn):
                now = np.zeros(self.blocks, bool)
                now[turn] = True
                self._score(score, now[block], head, share, of)
                opened |= now
                best_k = score[score > 0]
                least = np.partition(best_k, -k)[-k] if len(best_k) >= k else 0.0
                turn = np.flatnonzero((bound >= least) & ~opened)
            found = np.flatnonzero(score >= max(least, np.nextafter(0, 1)))
            yield query, found, score[found], head, opened[block]

    def _score(self, score: np.ndarray, now: np.ndarray, head: np.ndarray, share: np.ndarray, of: int) -> None:
        """Put the scores of the documents of some heads into ``score``."""
        head, share = head[now], share[now]
        at, share = _ranges(self.start[head], self.n[head]), np.repeat(share, self.n[head])
        doc = self.doc[at]
        cosine, hit = np.bincount(doc, share * self.weight[at], self.docs), np.bincount(doc, minlength=self.docs)
        score += cosine * (1 - COVERED + COVERED * hit / of)


def _found(rows: pa.Table, keys: pa.Table, k: int) -> pa.Table:
    """(query, key, score) of the best ``k`` of one span for each query, ties by key."""
    if not rows.num_rows:
        kinds = rows.schema.field("asks").type.value_type.field("query").type, keys.schema.field("keys").type.value_type, pa.float64()
        return pa.table([pa.array([], kind) for kind in kinds], ["query", "key", "score"])
    span, keys = _Span(rows, _flat(keys, "norms")), keys.combine_chunks()["keys"].chunk(0).flatten()
    rank = _rank(pc.array_sort_indices(keys).to_numpy())
    queries, docs, scores = [], [], []
    for query, doc, score, _, _ in span.search(k):
        top = np.lexsort((rank[doc], -score))[:k]
        queries.append(np.full(len(top), query))
        docs.append(doc[top])
        scores.append(score[top])
    return pa.table([span.queries.take(pa.array(np.concatenate(queries))), keys.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["query", "key", "score"])


def _seen(rows: pa.Table, keys: pa.Table, k: int) -> pa.Table:
    """(query, token, block, n, scored) of all heads of one span that each query meets."""
    if not rows.num_rows:
        kinds = rows.schema.field("asks").type.value_type.field("query").type, pa.string(), pa.int64(), pa.int64(), pa.bool_()
        return pa.table([pa.array([], kind) for kind in kinds], ["query", "token", "block", "n", "scored"])
    span = _Span(rows, _flat(keys, "norms"))
    row, first = np.repeat(np.arange(len(span.tokens)), np.diff(span.heads)), rows["span"][0].as_py() * (NUMBERS // BLOCK)
    parts = [(np.full(len(head), query), head, scored) for query, _, _, head, scored in span.search(k)]
    query, head, scored = (np.concatenate(x) for x in zip(*parts))
    return pa.table([span.queries.take(pa.array(query)), span.tokens.combine_chunks().take(pa.array(row[head])), pa.array(span.block[head].astype(np.int64) + first), pa.array(span.n[head]), pa.array(scored)], ["query", "token", "block", "n", "scored"])


class TextIndex:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self.terms, self.keys = (spark.read.parquet(f"{path}/{part}") for part in ("terms", "keys"))
        kind = self.keys.schema["key"].dataType.simpleString()
        self.postings = _rows(spark, path, kind).where(F.col("folder") != KEYS).drop("keys", "norms")
        self.spans = _rows(spark, path, kind).where(F.col("folder") == KEYS).select("span", "keys", "norms")

    def asked(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """(query, token, folder, share, of): the tokens of each query that the index has, their share of its unit vector, and how many tokens it has."""
        counts = queries.select("query", F.explode(tokens(text)).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("tf"))
        known = counts.join(self.terms, "token", "left").select("query", "token", (F.col("tf") * F.coalesce("idf", F.lit(0.0)) * token_weight("token")).alias("qv"))
        own = Window.partitionBy("query")
        shares = known.select("query", "token", _folder("token").alias("folder"), F.try_divide(F.col("qv"), F.sqrt(F.sum(F.col("qv") * F.col("qv")).over(own))).alias("share"), F.count(F.lit(1)).over(own).alias("of"))
        return shares.where("share > 0")

    def search(self, queries: DataFrame, k: int, text: str = "text", read: list[DataFrame] | None = None) -> DataFrame:
        """(query, key, score, place): what best(tfidf(docs, queries), k) gives.

        ``queries`` (query, text) is a stated set.  ``read``, if given, is filled
        with the blocks that were scored, and with all that the queries' tokens
        stand in, as (query, token, block, n).
        """
        asked = written(self.asked(queries, text).groupBy("folder", "token").agg(F.collect_list(F.struct("query", "share", "of")).alias("asks")), "asked")
        size = asked.agg(F.sum(64 + 48 * F.size("asks"))).first()[0] or 0
        met = self.postings.join(F.broadcast(asked) if size <= SMALL else asked, ["folder", "token"]).select("span", "token", "lift", "held", "tfs", "asks").groupBy("span").cogroup(self.spans.groupBy("span"))
        query, key = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (self.keys, "key")))
        if read is not None:
            seen = met.applyInArrow(lambda rows, keys: _seen(rows, keys, k), f"query {query}, token string, block long, n long, scored boolean")
            read += [df.select("query", "token", "block", "n") for df in (seen.where("scored"), seen)]
        found = met.applyInArrow(lambda rows, keys: _found(rows, keys, k), f"query {query}, key {key}, score double")
        return best(found, k)
