"""Hashed text vectors, inverse document frequency of their dimensions, and search by inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from ..functions.text import pair_tokens
from .closest import by_dimensions, closest
from .retrieval import best, nearest
from .written import written

#: Dimensions of a hashed vector, the bit of the hash that gives the sign, and vectors below which all are compared.
DIMENSIONS, LEAST_DIMENSIONS, SIGN_BIT, EXACT_BELOW = 512, 64, 40, 5000
#: The lists' centres are fitted on at most so many vectors, by hash of the key.
FITTED = 100_000
#: Entries of dense vectors that are made at once.
DENSE = 1 << 21
#: Lists at most, vectors of a part of a list, queries that a part meets at once.
MOST_LISTS, PART, QUERY_BLOCK = 1024, 16_384, 50_000
#: Vectors whose true neighbours set how far lists are opened, and the share of those neighbours to find.
HELD, TARGET = 256, 0.97


@F.pandas_udf(LongType())
def _code(tokens: pd.Series) -> pd.Series:
    """The first 64 bits of BLAKE2b, each distinct token of a batch hashed once."""
    code = {t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=False) for t in set(tokens)}
    return tokens.map(lambda t: code[t] - (1 << 64) if code[t] >> 63 else code[t])


def embed(docs: DataFrame, key: str = "key", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, dim, value): sparse unit vectors; a dimension is the signed sum s of its tokens, as sign(s) (1 + ln |s|).

    Texts without a token, and dimensions whose signs cancel out, have no row.
    """
    size = max(LEAST_DIMENSIONS, dimensions)
    tokens = docs.select(F.col(key).alias("key"), F.explode(pair_tokens(text)).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))
    code = tokens.select("key", "tf", _code("token").alias("code"))
    # The code is unsigned: 2**64 = 0 modulo a power of two, and else the rest is added.
    dim = F.pmod(F.pmod("code", F.lit(size)) + F.when(F.col("code") < 0, (1 << 64) % size).otherwise(0), F.lit(size)).cast("int")
    sign = 1 - 2 * F.shiftrightunsigned("code", SIGN_BIT).bitwiseAND(F.lit(1))
    sums = code.groupBy("key", dim.alias("dim")).agg(F.sum(F.col("tf") * sign).alias("s")).where("s <> 0")
    raw = sums.select("key", "dim", (F.signum("s") * (1 + F.log(F.abs("s")))).alias("x"))
    # A vector has ``size`` rows at most.
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("key")))
    return raw.select("key", "dim", (F.col("x") / norm).alias("value"))


def sparse(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, value) of the entries that aren't 0 of dense vectors."""
    return vectors.select(F.col(key).alias("key"), F.posexplode(vector).alias("dim", "value")).where("value <> 0").withColumn("value", F.col("value").cast("double"))


def dimension_idf(entries: DataFrame) -> DataFrame:
    """(dim, df, idf) with idf = ln((N + 1) / (df + 1)) over sparse vectors (key, dim, value)."""
    n = entries.agg(F.count_distinct("key").alias("__n"))  # one row
    return entries.groupBy("dim").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("dim", "df", F.log((F.col("__n") + 1) / (F.col("df") + 1)).alias("idf"))


def _dense(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(name, vector) of (name, list of (dim, w)): a place for each of ``width`` dimensions, DENSE of them at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, DENSE // width)):
            some = batch.slice(start, max(1, DENSE // width))
            of = some.column("of")
            matrix = np.zeros((some.num_rows, width))
            entries = of.flatten()
            matrix[np.repeat(np.arange(some.num_rows), of.value_lengths().to_numpy(zero_copy_only=False)), entries.field("dim").to_numpy()] = entries.field("w").to_numpy()
            ends = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))], [some.schema.names[0], "vector"])


def search(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, score, place): the ``k`` sparse vectors of greatest cosine above 0, both sides weighed by idf.

    ``asked`` (query, dim, value) is a stated set of queries.  Vectors are put
    together and compared by matrix products, so that what is shuffled grows with
    the entries and not with the pairs.
    """
    idf = dimension_idf(entries)
    weigh = lambda df, name: df.join(F.broadcast(idf.select("dim", "idf")), "dim").select(name, "dim", (F.col("value") * F.col("idf")).alias("w"))  # noqa: E731, a row for each dimension
    size = entries.agg(F.max("dim")).first()[0]
    if size is None:
        return asked.select("query", F.lit(None).cast(entries.schema["key"].dataType).alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)

    def dense(df: DataFrame, name: str) -> DataFrame:
        told = df.groupBy(name).agg(F.collect_list(F.struct("dim", "w")).alias("of"))
        return told.mapInArrow(partial(_dense, width=size + 1), f"{name} {df.schema[name].dataType.simpleString()}, vector array<double>")

    found = nearest(written(dense(weigh(entries, "key"), "key"), "weighed"), dense(weigh(asked, "query"), "query"), k)
    return found.select("query", "key", "score", "place")


def mismatched(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector is missing or has another number of dimensions than the index."""
    return vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != dimensions)


class InvertedLists:
    """Vectors (key, vector) in lists around centres; a search opens the lists that are near enough to a query.

    Below ``exact_below`` vectors there are no lists, and a search compares all.
    Otherwise KMeans centres are fitted on a bounded sample, and every vector
    stands in its two nearest lists.  How much farther than the nearest list a
    list may be and still be opened, ``reach``, is found on held queries: for
    HELD vectors their true ``k`` neighbours are searched exactly, and ``reach``
    is what opens a list of ``target`` of them.

    Large lists are split into parts, so that a list that holds a third of all
    vectors is no single task.  Vectors without direction are in no list, as they
    have no cosine.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, seed: int = 42, exact_below: int = EXACT_BELOW, k: int = 10, target: float = TARGET) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.vectors = vectors.select("key", "vector")
        told = self.vectors.where("exists(vector, x -> x <> 0) and not exists(vector, x -> x is null or isnan(x))")
        sizes = told.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").take(1)
        self.n = sizes[0].n if sizes else 0
        self.exact = self.n < max(2, exact_below)
        if self.exact:
            return
        told = told.where(F.size("vector") == sizes[0].d)
        lists = lists or max(2, min(MOST_LISTS, int(self.n**0.5)))
        sample = told.orderBy(F.xxhash64("key", F.lit(seed))).limit(FITTED)
        model = KMeans(k=lists, seed=seed, distanceMeasure="cosine").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
        centres = np.array(model.clusterCenters())
        self.centres = centres / np.maximum(np.sqrt((centres * centres).sum(1)), 1e-12)[:, None]
        placed = written(self._listed(told, "key", lambda near: np.sort(near, axis=1)[:, -min(2, near.shape[1])]), "placed")
        sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each list
        parts = told.sparkSession.createDataFrame([(r.list, -(-r.n // PART)) for r in sizes], "list int, parts int")
        self.placed = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        self.parts = parts
        self.reach = self._reach(told, placed, k, target, seed)
        self.spans = self._spans(told)

    def _listed(self, df: DataFrame, name: str, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """Rows (``name``, vector) once for each list whose centre is as near as ``least`` of all nearnesses says."""
        centres = self.centres
        kind = df.schema[name].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, (rows, matrix) in by_dimensions(batch.column("vector")).items():
                    if d == centres.shape[1]:
                        near = matrix @ centres.T
                        row, at = np.nonzero(near >= least(near)[:, None])
                        of = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(name).take(of), batch.column("vector").take(of)], ["list", name, "vector"])

        vector = df.schema["vector"].dataType.simpleString()
        return df.select(name, "vector").mapInArrow(run, f"list int, {name} {kind}, vector {vector}")

    def _spans(self, told: DataFrame) -> np.ndarray:
        """The widest angle between each centre and a vector that it is the nearest to; -inf of a list that is nobody's nearest."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            widest = np.full(len(centres), -np.inf)
            for batch in batches:
                for d, (_, matrix) in by_dimensions(batch.column("vector")).items():
                    if d == centres.shape[1]:
                        near = matrix @ centres.T
                        np.maximum.at(widest, near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1)))
            at = np.flatnonzero(widest > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(widest[at])], ["list", "span"])

        spans = np.full(len(centres), -np.inf)
        for r in told.select("vector").mapInArrow(run, "list int, span double").groupBy("list").agg(F.max("span").alias("span")).collect():  # a row for each list
            spans[r.list] = r.span
        return spans

    def _reach(self, told: DataFrame, placed: DataFrame, k: int, target: float, seed: int) -> float:
        held = written(told.orderBy(F.xxhash64("key", F.lit(seed + 1))).limit(HELD).withColumnRenamed("key", "query"), "held")
        true = nearest(told, held, k + 1).where("key <> query").select("query", "key")
        # HELD x k neighbours in two lists each, and HELD vectors.
        pairs = true.join(placed.select("key", "list"), "key").groupBy("query", "key").agg(F.collect_set("list").alias("lists")).collect()
        asked = {r.query: np.array(r.vector, float) for r in held.collect()}
        short = []
        for r in pairs:
            near = self.centres @ (asked[r.query] / np.sqrt((asked[r.query] ** 2).sum()))
            short.append(near.max() - near[r.lists].max())
        return float(np.quantile(short, target)) if short else 2.0

    def search(self, asked: DataFrame, k: int, reach: float | None = None) -> DataFrame:
        """(query, key, score, place) of a stated set of queries (query, vector); a ``reach`` of 2 opens every list."""
        if self.exact:
            return nearest(self.vectors, asked, k)
        reach = self.reach if reach is None else reach
        queries = written(asked.select("query", "vector"), "asked")
        return self._within(queries, self._listed(queries, "query", lambda near: near.max(1) - reach - 1e-12), k)

    def exactly(self, asked: DataFrame, k: int) -> DataFrame:
        """search() that misses nothing: after the lists within reach, every list that can hold a vector nearer than the k-th found.

        A vector is no nearer to a query than the angle between the query and
        the vector's nearest centre, less the widest angle of that centre's list.
        """
        if self.exact:
            return nearest(self.vectors, asked, k)
        queries = written(asked.select("query", "vector"), "asked")
        centres, spans, reach = self.centres, self.spans, self.reach
        found = written(self._within(queries, self._listed(queries, "query", lambda near: near.max(1) - reach - 1e-12), k), "found")
        # Of a query with fewer than k results every vector at less than a right angle counts.
        least = found.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("least"))
        asked = queries.join(least, "query", "left").select("query", "vector", F.coalesce("least", F.lit(0.0)).alias("least"))
        kind = asked.schema["query"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = np.arccos(np.clip(batch.column("least").to_numpy(), -1, 1))
                for d, (rows, matrix) in by_dimensions(batch.column("vector")).items():
                    if d == centres.shape[1]:
                        near = matrix @ centres.T
                        # Lists of the first round are left out; angles round.
                        more = (np.arccos(np.clip(near, -1, 1)) - spans <= bound[rows][:, None] + 1e-6) & (near < near.max(1)[:, None] - reach - 1e-12)
                        row, at = np.nonzero(more)
                        of = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("query").take(of), batch.column("vector").take(of)], ["list", "query", "vector"])

        vector = queries.schema["vector"].dataType.simpleString()
        rest = self._within(queries, asked.mapInArrow(run, f"list int, query {kind}, vector {vector}"), k)
        both = found.drop("place").unionByName(rest.drop("place"))
        return best(both.groupBy("query", "key").agg(F.max("score").alias("score")), k)

    def _within(self, queries: DataFrame, opened: DataFrame, k: int) -> DataFrame:
        """(query, key, score, place): the best ``k`` within the ``opened`` lists (list, query, vector) of each query."""
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        opened = opened.join(F.broadcast(self.parts), "list")
        opened = opened.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query", "vector")
        own = self.placed if blocks == 1 else self.placed.join(F.broadcast(opened.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))))
        own = own.withColumn("block", F.lit(0)) if blocks == 1 else own
        schema = f"query {queries.schema['query'].dataType.simpleString()}, key {own.schema['key'].dataType.simpleString()}, score double"

        def compare(vectors: pa.Table, block: pa.Table) -> pa.Table:
            return closest(block.select(["query", "vector"]), [vectors.select(["key", "vector"])], k, 0.0).cast(kind)

        kind = pa.schema([("query", to_arrow_type(queries.schema["query"].dataType)), ("key", to_arrow_type(own.schema["key"].dataType)), ("score", pa.float64())])
        by = ["list", "part", "block"]
        found = own.groupBy(*by).cogroup(opened.groupBy(*by)).applyInArrow(compare, schema)
        return best(found.groupBy("query", "key").agg(F.max("score").alias("score")), k)
