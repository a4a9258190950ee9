"""What a result was made from, and how much of it is shown."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.masking import mask, mask_text
from .written import written

#: Rows of a shown result, at least and at most.
FEWEST, MOST = 1, 500


def used_tables(df: DataFrame) -> list[str]:
    """Names of the files or folders that a result is read from, without their suffix."""
    names = set()
    for path in df.inputFiles():
        parts = [p for p in path.split("/") if re.search(r"\.(parquet|csv|json|jsonl|xml)$", p)]
        if parts:
            names.add(parts[0].rpartition(".")[0])
    return sorted(names)


def capped(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows (1 to 500) by ``order``, with ``truncated``: whether there are more."""
    cap = max(FEWEST, min(cap, MOST))
    first = df.orderBy(*order).limit(cap + 1)
    # 501 rows at most.
    placed = first.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > cap).withColumn("__k", F.row_number().over(Window.orderBy(*order)))
    return placed.where(F.col("__k") <= cap).drop("__k")


def recorded(df: DataFrame, name: str, sql: str) -> DataFrame:
    """One row (kind, name, tables, n_rows, sql) about a result; literals of the statement are masked as free text."""
    return df.agg(F.lit("query").alias("kind"), F.lit(name).alias("name"), F.array(*[F.lit(t) for t in used_tables(df)]).alias("tables"), F.count(F.lit(1)).alias("n_rows"), mask_text(F.lit(sql)).alias("sql"))


def observed(df: DataFrame, name: str, sql: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df`` that counts its rows as it runs, and what gives recorded()'s row once it has run, without another run."""
    seen = Observation()
    tables = used_tables(df)

    def row() -> DataFrame:
        made = [("query", name, tables, seen.get["n_rows"], sql)]
        return df.sparkSession.createDataFrame(made, "kind string, name string, tables array<string>, n_rows long, sql string").withColumn("sql", mask_text("sql"))

    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), row


def answered_and_recorded(df: DataFrame, order: list[str], cap: int, name: str, sql: str, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """answered() and the row about its source, of one execution of ``df``; n_rows counts all rows, not those shown."""
    counted, row = observed(df, name, sql)
    shown = written(answered(counted, order, cap, suffix), "shown")
    return shown, row()


def merged_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows (kind, name, tables, n_rows, sql, at) by kind and name: all tables, the latest rows and statement."""
    both = old.unionByName(new)
    last = both.groupBy("kind", "name").agg(F.max_by("n_rows", "at").alias("n_rows"), F.max_by("sql", "at").alias("sql"), F.max("at").alias("at"))
    tables = both.select("kind", "name", F.explode_outer("tables").alias("t")).distinct().groupBy("kind", "name").agg(F.sort_array(F.collect_set("t")).alias("tables"))
    return last.join(tables, ["kind", "name"])


def answered(df: DataFrame, order: list[str], cap: int, suffix: str = "") -> DataFrame:
    """capped() with personal data masked: what a reader of a query is shown."""
    shown = capped(df, order, cap)
    return mask(shown, suffix)


def preview(df: DataFrame, order: list[str], rows: int = 3) -> DataFrame:
    """The first rows of a table, masked."""
    return mask(df.orderBy(*order).limit(rows))


def owners(tables: dict[str, list[str]], used: list[str]) -> str:
    """The one database that holds all tables of a statement, qualified names first; else an error."""
    named = {u.split(".")[0] for u in used if "." in u}
    fits = named or {db for db, own in tables.items() if all(u in own for u in used)}
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} databases fit {used}")
    return fits.pop()
