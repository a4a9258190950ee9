"""A small table that is switched in one write: readers see the rows of one version, whole, also while the next is written.

Two folders take turns.  Version n goes to folder n % 2, and the folder of
version n - 1 stays as it is, so that a write that fails halfway, or is under
way, leaves the version before in use.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Slots:
    """Rows of ``schema`` under ``root``, some thousands at most."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def read(self) -> tuple[int, list]:
        """The version in use and its rows; -1 and none before the first."""
        found = (-1, [])
        for k in (0, 1):
            try:
                rows = self.spark.read.schema(f"{self.schema}, version int, whole int").json(f"{self.root}/slot={k}").collect()
            except AnalysisException:  # not written yet, or just being replaced
                continue
            if rows and len(rows) == rows[0].whole and rows[0].version > found[0]:
                found = rows[0].version, rows
        return found

    def write(self, rows: list[tuple], version: int) -> None:
        frame = self.spark.createDataFrame(rows, self.schema)
        told = frame.withColumns({"version": F.lit(version), "whole": F.lit(len(rows))})
        told.coalesce(1).write.mode("overwrite").json(f"{self.root}/slot={version % 2}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_PARTS = "name string, kind string, path string, n_rows long"


def publish(tables: dict[str, DataFrame], catalog: DataFrame, root: str, info: DataFrame | None = None, keep: int = 2) -> int:
    """Write tables, their catalog and build info as one version under ``root`` and take them into use together; the version.

    Each part goes to a folder of its own; one last small write names them all,
    so a reader gets all parts of one version.  The folders of versions before the
    last ``keep`` are deleted.
    """
    spark = catalog.sparkSession
    slots = Slots(spark, f"{root}/current", _PARTS)
    version = slots.read()[0] + 1
    parts = [("table", n, df) for n, df in tables.items()] + [("catalog", "catalog", catalog)] + ([("info", "info", info)] if info is not None else [])
    rows = []
    for kind, name, df in parts:
        path = f"{root}/v={version}/{kind}/{len(rows)}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, kind, path, spark.read.parquet(path).count()))
    slots.write(rows, version)
    if version >= keep:
        remove(spark, f"{root}/v={version - keep}")
    return version


def published(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame | None]:
    """The tables by name, the catalog and the build info of the version in use."""
    version, rows = Slots(spark, f"{root}/current", _PARTS).read()
    if version < 0:
        raise ValueError(f"nothing is published under {root}")
    of = {r.kind: {x.name: spark.read.parquet(x.path) for x in rows if x.kind == r.kind} for r in rows}
    return of.get("table", {}), of["catalog"]["catalog"], of.get("info", {}).get("info")
