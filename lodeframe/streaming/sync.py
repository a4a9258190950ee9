"""Incremental synchronisation of a keyed table, in batch and from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by ``order``; combined before the shuffle, so a busy key is no bottleneck."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, order).alias("__row")).select("__row.*")


def changes(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change): unchanged, written (new or different) or removed, for each key of either table.

    Values are compared one by one, and a null equals only a null.
    """
    side = lambda df, name: df.select(key, F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(values)]).alias(name))
    both = side(old, "__a").join(side(new, "__b"), key, "full")
    same = F.lit(True)
    for k in range(len(values)):
        same &= F.col(f"__a.v{k}").eqNullSafe(F.col(f"__b.v{k}"))
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull() | ~same, "written").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def vanished(old: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is not in ``keep``: what a prune takes away."""
    return old.join(keep.select(key), key, "left_anti")


def signature(files: DataFrame) -> DataFrame:
    """One row (files, bytes, digest) for a table of files (path, length, modificationTime): it changes when any of them does."""
    one = F.xxhash64("path", "length", "modificationTime")
    # Sums of digests don't depend on the order, and are combined before the shuffle.
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.pmod(one, F.lit(1 << 40))), F.lit(0)).alias("digest"))


def is_stale(files: DataFrame, known: DataFrame) -> bool:
    """Whether ``known``, an earlier signature() or no row, differs from that of ``files``."""
    return signature(files).exceptAll(known).count() > 0


def version_path(root: str, version: int) -> str:
    return f"{root}/v={version}"


def replace_table(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write ``df`` as the next version of the table under ``root`` and take it into use by one small last write.

    Readers see the old version until ``current`` names the new one; versions
    older than the last ``keep`` are removed.
    """
    spark = df.sparkSession
    now = current_version(spark, root)
    version = 0 if now is None else now + 1
    df.write.mode("overwrite").parquet(version_path(root, version))
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/current")
    _drop_versions(spark, root, version - keep)
    return version


def _drop_versions(spark: SparkSession, root: str, last: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while last >= 0 and fs.exists(path(version_path(root, last))):
        fs.delete(path(version_path(root, last)), True)
        last -= 1


def current_version(spark: SparkSession, root: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(f"{root}/current")):
        return None
    # One row a version.
    return spark.read.schema("version int").json(f"{root}/current").agg(F.max("version")).first()[0]


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The version in use."""
    return spark.read.parquet(version_path(root, current_version(spark, root)))


def running_counts(stream: DataFrame, key: str, at: str) -> DataFrame:
    """(key, hits, last) of each key of a batch or a stream: repeats count up, the newest time stays."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.max(at).alias("last"))


def noted(old: DataFrame, new: DataFrame, text: str, tags: str, at: str) -> DataFrame:
    """Notes (text, tags, importance, at) after ``new`` ones (text, tags, at) were taken in.

    Notes of the same normalised text are one: its first wording, all tags, the
    newest time, and an importance of one more for each repeat, five at most.
    """
    held = old.select(text, tags, "importance", at, F.lit(0).alias("__new")).unionByName(new.select(text, tags, F.lit(1).alias("importance"), at, F.lit(1).alias("__new")))
    held = held.withColumn("__key", normalised(text))
    first = F.min_by(F.struct(text, "importance"), F.struct("__new", at, text))
    same = held.groupBy("__key").agg(first.alias("__first"), F.count(F.lit(1)).alias("__n"), F.max(at).alias(at))
    # Distinct tags only, however often a note is repeated.
    all_tags = held.select("__key", F.explode(tags).alias("__tag")).distinct().groupBy("__key").agg(F.sort_array(F.collect_set("__tag")).alias(tags))
    joined = same.join(all_tags, "__key", "left")
    return joined.select(F.col(f"__first.{text}").alias(text), F.coalesce(tags, F.array().cast("array<string>")).alias(tags), F.least(F.lit(5), F.col("__first.importance") + F.col("__n") - 1).cast("int").alias("importance"), at)
