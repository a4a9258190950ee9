"""A keyed table on disk that takes in batches of changes without being rewritten.

Keys are dealt to buckets by a hash.  A batch writes one small file of changes
for each bucket that it touches; a bucket with many such files is merged into a
new base.  A manifest, switched by one small write, names each bucket's base and
its files of changes; a batch that is run again finds itself in it and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .slots import Slots
from .sync import latest

#: Buckets of a new table, and files of changes that a bucket holds before it is merged.
BUCKETS, CHANGES = 64, 8
_MANIFEST = "bucket int, buckets int, base long, changes array<long>"
_BATCH, _GONE, _BUCKET = "__batch", "__gone", "__bucket"


class KeyedTable:
    """Rows of ``schema`` under ``root``, one for each value of ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.schema = spark, root, key, schema
        self.slots = Slots(spark, f"{root}/manifest", _MANIFEST)
        self.buckets = buckets

    def _state(self) -> tuple[int, dict[int, tuple[int, list[int]]]]:
        """The last batch, and for each bucket the batch that made its base (-1: none) and the batches of its changes."""
        version, rows = self.slots.read()
        if rows:
            self.buckets = rows[0].buckets
        return version, {r.bucket: (r.base, list(r.changes)) for r in rows if r.bucket >= 0}

    def _files(self, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, {_BATCH} long, {_GONE} boolean"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, state: dict[int, tuple[int, list[int]]]) -> DataFrame:
        """The rows of some buckets: the last change of each key, and the base rows whose key has no change."""
        base = self._files([f"{self.root}/base/{b}/bucket={k}" for k, (b, _) in state.items() if b >= 0])
        changed = self._files([f"{self.root}/changes/{n}/bucket={k}" for k, (_, ns) in state.items() for n in ns])
        last = latest(changed, self.key, _BATCH)
        # A null key equals itself.
        known = last.select(F.col(self.key).alias("__key"))
        kept = base.join(known, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        return kept.unionByName(last.where(~F.col(_GONE)))

    def read(self) -> DataFrame:
        """All rows as they are after the last batch."""
        return self._merged(self._state()[1]).drop(_BATCH, _GONE)

    def apply(self, rows: DataFrame, batch: int, order: str | None = None, gone: str | None = None) -> list[int]:
        """Take in batch number ``batch``, above all earlier ones, and return the buckets it wrote; one that was taken in changes nothing.

        Of rows with one key the last by ``order`` counts, and a row whose column
        ``gone`` is true deletes its key.  Files of a batch that failed halfway are
        written anew.
        """
        version, state = self._state()
        if batch <= version:
            return []
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        marked = rows.withColumn(_GONE, F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False))
        if order:
            marked = latest(marked, self.key, order)
        else:
            marked = marked.dropDuplicates([self.key])
        placed = marked.select(*names, F.lit(batch).cast("long").alias(_BATCH), _GONE, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))
        path = f"{self.root}/changes/{batch}"
        # One file for each bucket, so a task for each.
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # As many rows as there are buckets.
        schema = f"{self.schema}, {_BATCH} long, {_GONE} boolean, bucket int"
        touched = [r.bucket for r in self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()]
        for k in touched:
            base, changes = state.get(k, (-1, []))
            state[k] = base, [*changes, batch]
        full = {k: state[k] for k in touched if len(state[k][1]) >= CHANGES}
        if full:
            merged = self._merged(full).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/{batch}")
            left = {r.bucket for r in self.spark.read.schema(schema).parquet(f"{self.root}/base/{batch}").select("bucket").distinct().collect()}
            state |= {k: (batch if k in left else -1, []) for k in full}
        # A row of bucket -1 keeps the manifest from being empty.
        self.slots.write([(-1, self.buckets, -1, []), *((k, self.buckets, *state[k]) for k in sorted(state))], batch)
        return sorted(touched)

    def prune(self, keep: DataFrame, batch: int) -> list[int]:
        """Delete the keys that ``keep`` lacks."""
        own = self.read()
        known = keep.select(F.col(self.key).alias("__key"))
        away = own.join(known, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti").withColumn("__away", F.lit(True))
        return self.apply(away, batch, gone="__away")


def upsert_stream(spark: SparkSession, stream: DataFrame, root: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS, gone: str | None = None):
    """Start a query that takes each micro-batch of ``stream`` into the KeyedTable under ``root``.

    A batch touches the buckets of its keys alone.  The last row of each key by
    ``order`` counts within a batch, and a later batch goes before an earlier one.
    """
    fields = [f for f in stream.schema.fields if f.name != gone]
    table = KeyedTable(spark, root, key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, order, gone)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
