"""Global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def next_value(df: DataFrame, key: str, name: str) -> DataFrame:
    """For distinct ``key`` values, add ``name``: the next larger one, for the largest the smallest."""
    part = "__part"
    ranged = materialise(df.repartitionByRange(tasks(df), key).withColumn(part, F.spark_partition_id()), "next")
    inside = ranged.withColumn(name, F.lead(key).over(Window.partitionBy(part).orderBy(key)))
    firsts = ranged.groupBy(part).agg(F.min(key).alias("__first"))
    # One row for each partition that has rows.
    whole = Window.orderBy(part)
    wrap = F.first("__first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.withColumn("__after", F.coalesce(F.lead("__first").over(whole), wrap)).drop("__first")
    return inside.join(F.broadcast(after), part).withColumn(name, F.coalesce(name, "__after")).drop(part, "__after")
