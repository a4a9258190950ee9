"""Which columns are measures, and the analyses that start from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import kind_of, mask_cell, mask_text
from .stats import clusters, correlations, outliers, portraits, profile
from .written import written

#: Words of column names that tell ids, codes and flags, and the bounds of the rules for whole numbers.
ID_NAME = r"(^|_)(id|ids|code|no|num|seq|status|flag|version|is_[a-z_]+)($|_)"
MOST_MISSING, UNIQUE, UNIQUE_ROWS, FLAG_VALUES, FLAG_ROWS = 0.6, 0.95, 30, 2, 20
PLOTTED, CHART_SCAN, CHART_POINTS = 0.8, 200, 150
#: Rows of a sample, at least and at most.
SAMPLED = (100, 20_000)


def to_float(value: Column) -> Column:
    """A cell as a double, null if it is none."""
    return value.cast("string").try_cast("double")


def measure_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, reason) for each column; the reason is empty for a measure.

    Left out are columns with over 60 % missing, those with names of ids, codes or
    flags, and whole numbers that hardly repeat or have two values at most.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), to_float(F.col(f"`{c}`")).alias("value")) for c in columns])).alias("c")
    counts = df.select(cells).select("c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Values are counted first: a frequent one is one row from here on.
    v, n = F.col("value"), F.col("n")
    facts = counts.groupBy("column").agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("filled"), F.count(v).alias("distinct"), F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias("whole")
    )
    missing = 1 - F.try_divide(F.col("filled"), F.col("rows"))
    filled, distinct = F.col("filled"), F.col("distinct")
    reason = (
        F.when(missing > MOST_MISSING, "missing")
        .when(F.lower("column").rlike(ID_NAME), "id, code or status")
        .when(filled == 0, "no number")
        .when(F.col("whole") & (filled >= UNIQUE_ROWS) & (distinct / filled > UNIQUE), "hardly repeats")
        .when(F.col("whole") & (filled >= FLAG_ROWS) & (distinct <= FLAG_VALUES), "two values")
        .otherwise("")
    )
    return facts.select("column", missing.alias("missing"), reason.alias("reason"))


def measures(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Names of the measure columns, in order."""
    columns = columns or df.columns
    kept = {r.column for r in measure_report(df, columns).where("reason = ''").collect()}  # a row for each column
    return [c for c in columns if c in kept]


def sampled(df: DataFrame, columns: list[str], limit: int = 5000, where: Column | str | None = None, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``columns`` of a sample of 100 to 20,000 rows: those whose keys (all columns, if none are named) have the least digest.

    The sample depends on the rows alone, not on how they are split, and each
    task hands on no more rows than are asked for.  ``where`` goes before it, down
    to the files.
    """
    missing = [c for c in [*columns, *(key or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    rows = df if where is None else df.where(where)
    told = F.concat_ws("\u001f", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in key or df.columns])
    limit = max(SAMPLED[0], min(limit, SAMPLED[1]))
    return rows.withColumn("__digest", F.md5(told)).orderBy("__digest").limit(limit).select(*[F.col(f"`{c}`") for c in columns])


def analyse(df: DataFrame, columns: list[str] | None = None, sample: int | None = None, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Profile and the correlations of the measure columns, strongest first; of all rows, or of a sampled() few."""
    if sample is not None:
        df = written(sampled(df, columns or df.columns, sample, key=key), "sampled")
    kept = measures(df, columns)
    if len(kept) < 2:
        raise ValueError("an analysis needs two measure columns")
    pairs = correlations(df, kept)
    return profile(df, kept), pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(6)


def anomalies(df: DataFrame, value: str, label: str, forest: bool = True) -> DataFrame:
    """outliers() with labels masked as their column's name tells, else as free text."""
    found = outliers(df.withColumn(label, F.col(label).cast("string")), value, label, forest)
    kind = kind_of(label)
    return found.withColumn(label, mask_cell(F.col(label), kind) if kind else mask_text(label))


def grouped(df: DataFrame, columns: list[str] | None = None, most: int = 6) -> tuple[DataFrame, int, float]:
    """Portraits of the clusters of the measure columns, their number and silhouette."""
    kept = measures(df, columns)
    placed, k, silhouette = clusters(df, kept, most)
    return portraits(placed, kept), k, silhouette


def plotted_columns(df: DataFrame) -> list[str]:
    """Columns of which four fifths of the filled cells are numbers."""
    share = lambda c: F.try_divide(F.count(to_float(F.col(f"`{c}`"))), F.count(F.col(f"`{c}`")))
    one = df.agg(*[share(c).alias(f"s{k}") for k, c in enumerate(df.columns)]).first()
    return [c for k, c in enumerate(df.columns) if (one[k] or 0) >= PLOTTED]


def chart_axes(df: DataFrame, x: str = "", ys: str = "") -> tuple[str, list[str]]:
    """The column for the x axis, named or the first that isn't numeric, and those for the y axis, named or all others that are."""
    numeric = plotted_columns(df)
    if not numeric:
        raise ValueError("no numeric column")
    across = x if x in df.columns else next((c for c in df.columns if c not in numeric), df.columns[0])
    up = [c for c in (n.strip() for n in ys.split(",")) if c in df.columns and c != across] or [c for c in numeric if c != across]
    if not up:
        raise ValueError("the only numeric column is on the x axis")
    return across, up


def chart_points(df: DataFrame, x: str, ys: list[str], order: str) -> DataFrame:
    """(place, label, y columns) of a chart: of the first 200 rows by ``order`` those with a new label and numbers all through, 150 at most."""
    from pyspark.sql import Window

    scanned = df.orderBy(order).limit(CHART_SCAN).select(F.col(x).cast("string").alias("label"), *[to_float(F.col(y)).alias(y) for y in ys], F.col(order).alias("__o"))
    # 200 rows at most from here on.
    first = scanned.where("label <> ''").withColumn("__k", F.row_number().over(Window.partitionBy("label").orderBy("__o"))).where("__k = 1")
    whole = first.where(F.forall(F.array(*ys), lambda v: v.isNotNull()))
    return whole.withColumn("place", F.row_number().over(Window.orderBy("__o"))).where(F.col("place") <= CHART_POINTS).select("place", "label", *ys)
