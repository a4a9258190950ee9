"""Intermediate tables in the folder that all executors share, and bounds on what tasks and the driver are sent."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of a table that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch that a Python worker is handed; a longer row is handed over alone.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a folder of
    our own is made if the setting is absent, and put into the setting, so that
    later calls agree on it; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodeframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more.

    Its cleaner waits for the driver's garbage to be collected, which on a driver
    with little to do may take half an hour; between large steps that is too long.
    """
    # What Python lets go of reaches the JVM after a moment, in time for the second round.
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _bytes(column: Column, kind: DataType) -> Column:
    """Bytes of a value, with some more for how Spark holds it."""
    if isinstance(kind, StringType | BinaryType):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        each = F.transform(column, lambda x: _bytes(x, kind.elementType).cast("long"))
        return 24 + F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    return F.lit(8)


def broadcastable(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, as a broadcast side if its rows have ``most`` bytes or fewer; else as it is."""
    size = df.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


_kept: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What an earlier task of this worker has made under ``name``, or else made now; see in_batches()."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _begin(keep: bool) -> None:
    if _kept and not keep:
        _kept.clear()
        _trim()


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keep: bool = False) -> DataFrame:
    """``df.mapInArrow(function, schema)`` in bounded memory.

    Python workers are handed batches of BATCH_BYTES, unless the session sets a
    bound of its own, and as Spark uses a worker again, it gives freed memory
    back to the system when a task ends.  What tasks have got by kept() stays in
    their worker for tasks with ``keep``; others let it go before they begin.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(name, None):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)
        yield from function(batches)
        _trim()

    return df.mapInArrow(run, schema)
