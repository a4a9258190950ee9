"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that a Python worker is handed; a longer row is handed over alone.
BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, below ``spark.checkpoint.dir``.

    Only in local mode, if the setting is absent, a temporary folder is made and
    put into the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodeframe"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: the planner knows its size, branches share one result, lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_bounded_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(function, schema)`` with batches of BATCH_BYTES, unless the session sets a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(name, None):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)
