"""Column profiles, correlation, voted outliers and clusters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import isolation
from .written import written

#: Grades of a correlation's size, and the most outliers that a report lists.
GRADES = [(0.9, "极强"), (0.7, "强"), (0.4, "中等"), (0.2, "弱")]
NO_GRADE = "极弱/无"
REPORTED, FALLBACK, FEWEST = 15, 5, 8
QUARTILES = [0.25, 0.5, 0.75]
#: Rows of a task that clusters them at most, and those that are worth a task.
ROWS, FEW = 1 << 17, 1 << 10


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): one row for each cell; text that is no number is null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def cumulative(cells: DataFrame) -> DataFrame:
    """(column, value, n, upto): how often each value of (column, value) rows occurs, and how many rows of its column come up to it.

    Values are counted first, so a frequent one is one row.  The counts are
    range-partitioned and written, summed inside each partition and shifted by
    the sums of the partitions before; no column is gathered in one place.
    """
    return summed_up(cells.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def summed_up(counts: DataFrame) -> DataFrame:
    """cumulative() of values that are counted already, (column, value, n)."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(counts.repartitionByRange(tasks, "column", "value").withColumn("__p", F.spark_partition_id()), "counts")
    # One row for each partition and column.
    before = placed.groupBy("column", "__p").agg(F.sum("n").alias("__t"))
    shift = F.sum("__t").over(Window.partitionBy("column").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("column", "__p", F.coalesce(shift, F.lit(0)).alias("__b"))
    inside = F.sum("n").over(Window.partitionBy("__p", "column").orderBy("value"))
    return placed.withColumn("__in", inside).join(F.broadcast(before), ["column", "__p"]).select("column", "value", "n", (F.col("__b") + F.col("__in")).alias("upto"))


def quantiles(cells: DataFrame, shares: list[float]) -> DataFrame:
    """(column, q): exact quantiles, interpolated, of each column of (column, value) rows, as an array."""
    return quantiles_of(written(cumulative(cells), "upto"), shares)


def quantiles_of(found: DataFrame, shares: list[float]) -> DataFrame:
    """quantiles() of what cumulative() has counted."""
    totals = found.groupBy("column").agg(F.max("upto").alias("__n"))  # one row for each column
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("__n") - 1) * p).alias("h")) for k, p in enumerate(shares)]))
    wanted = totals.select("column", at.alias("w")).select("column", "w.k", "w.h")
    hit = found.join(F.broadcast(wanted), "column").where((first <= F.ceil("h")) & (last >= F.floor("h")))
    # One or two rows for each quantile: the neighbours of its place.
    low, high = F.min("value"), F.max("value")
    each = hit.groupBy("column", "k").agg((low + (high - low) * (F.max("h") - F.floor(F.max("h")))).alias("v"))
    return each.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("q"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: n, missing, mean, std, least, quartiles, most, cv and skew.

    cv is std / mean, null for a mean of 0; skew is 3 (mean - median) / std, 0
    for a std of 0 or a single value.  Quartiles are exact and interpolated.
    """
    v = F.col("value")
    cells = long_form(df, columns)
    out = cells.groupBy("column").agg(
        F.count(v).alias("n"), (1 - F.try_divide(F.count(v), F.count(F.lit(1)))).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    out = out.join(F.broadcast(quantiles(cells, QUARTILES)), "column", "left")  # one row for each column
    p25, p50, p75 = (F.get("q", F.lit(k)) for k in range(3))
    std = F.when(F.col("n") > 0, F.coalesce("std", F.lit(0.0)))
    out = out.select("column", "n", "missing", "mean", std.alias("std"), "least", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "most")
    skew = F.when(F.col("n") > 0, F.coalesce(F.try_divide(3 * (F.col("mean") - F.col("p50")), "std"), F.lit(0.0)))
    return out.withColumns({"cv": F.try_divide("std", "mean"), "skew": skew})


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as doubles with missing values set to the column's mean, 0 where all are missing."""
    numbers = df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    means = numbers.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"__m{k}") for k, c in enumerate(columns)])
    return numbers.crossJoin(F.broadcast(means)).select(*[F.coalesce(c, f"__m{k}").alias(c) for k, c in enumerate(columns)])  # means: one row


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank of each value, ties averaged, without a window over all rows.

    A rank table has a row for each distinct value and is written, so that Spark
    broadcasts a small one and can split a frequent value where it shuffles.
    """
    ranks = written(cumulative(long_form(df, columns)).select("column", "value", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("__r")), "ranks")
    out = df
    for k, c in enumerate(columns):
        own = written(ranks.where(F.col("column") == c).select(F.col("value").alias(f"__v{k}"), F.col("__r").alias(f"__r{k}")), "rank")
        out = out.join(own, F.col(f"`{c}`") == F.col(f"__v{k}"))
    return out.select(*[F.col(f"__r{k}").alias(c) for k, c in enumerate(columns)])


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, grade) of each pair of columns, missing values set to the mean; a constant column has r = 0."""
    numbers = filled(df, columns)
    if method == "spearman":
        numbers = average_ranks(numbers, columns)
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    one = numbers.agg(*[both(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    r = lambda k: F.coalesce(F.nanvl(f"r{k}", F.lit(0.0)), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(k).alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).withColumn("grade", grade("r"))


def grade(r: Column | str) -> Column:
    size = F.abs(F.col(r) if isinstance(r, str) else r)
    out = F.lit(NO_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(size >= least, name).otherwise(out)
    return out


def outlier_votes(df: DataFrame, value: str, forest: bool = True) -> DataFrame:
    """``df`` with z, votes and the three votes that make them up; rows without a value are left out.

    Votes: over 3 standard deviations from the mean; over 1.5 interquartile
    ranges beyond the quartiles; odd to an isolation forest (of 20 values or
    more).  Without ``forest`` the third vote is ``by_median``, over 3.5 scaled
    median deviations from the median, which SQL can state.
    """
    v, third = F.col(value), "by_forest" if forest else "by_median"
    have = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    found = written(cumulative(have.select(F.lit("v").alias("column"), v.cast("double").alias("value"))), "upto")
    base = have.agg(F.count(F.lit(1)).alias("n"), F.avg(value).cast("double").alias("mean"), F.stddev_samp(value).alias("std")).first()
    if base.n < FEWEST:
        return have.limit(0).select(*df.columns, F.lit(0.0).alias("z"), *[F.lit(False).alias(c) for c in ("by_z", "by_range", third)], F.lit(0).alias("votes"))
    low, mid, high = quantiles_of(found, QUARTILES).first().q
    z = F.abs(v - base.mean) / base.std if base.std else F.lit(0.0)
    odd = F.lit(False)
    if forest and base.n >= isolation.FEWEST:
        odd = isolation.scores(value, isolation.fit(found, base.n), base.n) > isolation.ODD
    if not forest:
        # Values are counted already, so their distances from the median are too.
        off = found.groupBy("column", F.abs(F.col("value") - mid).alias("value")).agg(F.sum("n").alias("n"))
        mad = quantiles_of(written(summed_up(off), "upto"), [0.5]).first().q[0]
        odd = 0.6745 * F.abs(v - mid) / mad > 3.5 if mad else F.lit(False)
    reach = 1.5 * (high - low)
    out = have.select(*df.columns, z.alias("z"), odd.alias(third)).withColumn("by_z", F.col("z") > 3).withColumn("by_range", (v < low - reach) | (v > high + reach))
    return out.select(*df.columns, "z", "by_z", "by_range", third, (F.col("by_z").cast("int") + F.col("by_range").cast("int") + F.col(third).cast("int")).alias("votes"))


def outliers(df: DataFrame, value: str, label: str, forest: bool = True) -> DataFrame:
    """At most 15 rows (label, value, z, votes) with two votes or more; if there are none, 5 with one."""
    voted = outlier_votes(df, value, forest).where("votes >= 1").select(label, value, "z", "votes")
    sure = F.max("votes").over(Window.partitionBy()) >= 2
    top = voted.orderBy(F.desc("votes"), F.desc("z"), label).limit(REPORTED)  # so the window has 15 rows
    placed = top.withColumn("__sure", sure).withColumn("__k", F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("z"), label)))
    return placed.where((F.col("__sure") & (F.col("votes") >= 2)) | (~F.col("__sure") & (F.col("__k") <= FALLBACK))).drop("__sure", "__k")


def clusters(df: DataFrame, columns: list[str], most: int = 6, seed: int = 42) -> tuple[DataFrame, int, float]:
    """Rows with a ``cluster``, the number of clusters and their silhouette; the number with the best silhouette wins.

    Missing values are set to the mean, columns standardised, KMeans run for 2 up
    to ``most`` or the root of the row count.  Needs ten rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    numbers = VectorAssembler(inputCols=columns, outputCol="__raw").transform(filled(df, columns))
    # A narrow table is few splits of its file, and each is read anew in every step: its rows are dealt out, ROWS of them a task.
    rows = numbers.count()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(numbers).transform(numbers)
    scaled = scaled.select(*columns, "__x").repartition(min(tasks, max(1, rows // FEW))).persist()
    try:
        n = rows
        if n < 10:
            raise ValueError("clusters need ten rows")
        judge = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster")
        best = None
        for k in range(2, max(2, min(most, int(n**0.5))) + 1):
            placed = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(scaled).transform(scaled)
            if placed.select("cluster").distinct().count() < 2:
                continue
            score = judge.evaluate(placed)
            if best is None or score > best[2]:
                best = (placed.select(*columns, "cluster"), k, score)
    finally:
        scaled.unpersist()
    if best is None:
        raise ValueError("all rows are alike")
    return best


def portraits(placed: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, size, share, column, mean, z): the features whose cluster mean lies 0.6 standard deviations off, three at most."""
    overall = placed.agg(F.count(F.lit(1)).alias("__n"), *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__o{k}") for k, c in enumerate(columns)])
    groups = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"__g{k}") for k, c in enumerate(columns)])
    both = groups.crossJoin(F.broadcast(overall))  # one row
    z = lambda k: F.coalesce(F.try_divide(F.col(f"__g{k}") - F.col(f"__o{k}.m"), F.col(f"__o{k}.s")), F.lit(0.0))
    each = F.array(*[F.struct(F.abs(z(k)).alias("far"), F.lit(c).alias("column"), F.col(f"__g{k}").alias("mean"), z(k).alias("z")) for k, c in enumerate(columns)])
    top = F.slice(F.sort_array(F.filter(each, lambda x: x["far"] >= 0.6), asc=False), 1, 3)
    return both.select("cluster", "size", (F.col("size") / F.col("__n")).alias("share"), F.explode(top).alias("x")).select("cluster", "size", "share", "x.column", "x.mean", "x.z")
