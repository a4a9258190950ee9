"""Forecasts by trees that learn from all series at once, beside the candidates that learn from one.

A forest and boosted trees of MLlib are fitted over the lag rows of every series,
in one distributed job each, so that their cost grows with the months and not
with the number of models.  Values are divided by the mean size of the months that
a series learns from, and the trees guess the change to the month before: so
series of any level share splits, and a trend goes on beyond the values seen.

Recursion keeps a row for each series, with its last months as an array that
each step lengthens by its guess: no shuffle between the steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecast import FEWEST, HELD, LAGS, LONGEST, MODELS, errors, features
from .written import written

#: Lags that every row has; 0 where a series is too short.
K = LAGS[1]
INPUTS = ["i", "sin", "cos", *[f"lag{d}" for d in range(1, K + 1)]]
SEED = 42

#: The candidates, in order.  Their size is bounded, whatever the number of series.
TREES = {
    "forest": lambda: RandomForestRegressor(labelCol="change", numTrees=60, maxDepth=6, minInstancesPerNode=2, seed=SEED),
    "boosted": lambda: GBTRegressor(labelCol="change", maxIter=20, maxDepth=3, stepSize=0.3, seed=SEED),
}
OUT = ["ym", "v", "kind", "model", "rmse", "mae", "mape"]


def lag_months(n: Column) -> Column:
    """The first months of a series of ``n``, which are lags alone and no row to learn from."""
    return F.least(F.lit(LAGS[1]), F.greatest(F.lit(LAGS[0]), F.floor(n / 6))).cast("int")


def held_months(n: Column) -> Column:
    """Months at the end of a series of ``n`` that validate the candidates."""
    most = F.greatest(F.lit(HELD[0]), F.least(F.lit(HELD[1]), F.floor(n / 6)))
    return F.least(most, F.greatest(F.lit(2), n - lag_months(n) - 10)).cast("int")


def lag_rows(series: DataFrame, by: list[str]) -> DataFrame:
    """``series`` (by ..., ym, v) of 12 months or more with its features, scaled: v, level, change, n, stop (months before those held)."""
    w = Window.partitionBy(*by)
    filled = series.select(*by, "ym", F.coalesce(F.nanvl(F.col("v").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    counted = filled.withColumns({"n": F.count(F.lit(1)).over(w).cast("int"), "i": F.row_number().over(w.orderBy("ym")) - 1}).where(F.col("n") >= FEWEST)
    rows = counted.withColumn("stop", F.col("n") - held_months(F.col("n")))
    level = F.avg(F.when(F.col("i") < F.col("stop"), F.abs("v"))).over(w)
    scaled = rows.withColumn("level", level).withColumn("level", F.when(F.col("level") > 0, F.col("level")).otherwise(1.0)).withColumn("v", F.col("v") / F.col("level"))
    # Rounded, so that no tree splits at a last bit.
    return features(scaled, by, K).withColumns({"sin": F.round("sin", 9), "cos": F.round("cos", 9), "change": F.col("v") - F.col("lag1")})


def _month(ym: Column) -> Column:
    return F.substring(ym, 6, 2).cast("int")


def _state(rows: DataFrame, by: list[str], stop: Column) -> DataFrame:
    """A row for each series: its K months before ``stop``, and the months and values from there on, K + 12 rows each at most."""
    near = rows.where(F.col("i").between(stop - K, stop + HELD[1] - 1)).withColumn("now", F.col("i") < stop)
    listed = lambda c, of: F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("i", F.col(c).alias("x"))))), lambda s: s.x)
    made = near.groupBy(*by).agg(
        F.first("level").alias("level"), F.first(stop).cast("int").alias("start"), listed("v", F.col("now")).alias("path"), listed("v", ~F.col("now")).alias("truth"),
        listed("ym", ~F.col("now")).alias("yms"), F.max("ym").alias("last"),
    )
    return made.withColumn("path", F.concat(F.array_repeat(F.lit(0.0), K - F.size("path")), "path"))


def recurse(model, state: DataFrame, steps: int) -> DataFrame:
    """``state`` (..., start, path, yms) with ``guesses``: ``steps`` values, each of which is a lag for those after it.

    ``yms`` names the months guessed; where it is shorter, later guesses mean nothing.
    """
    pack = VectorAssembler(inputCols=INPUTS, outputCol="features")
    kept = state.columns
    for h in range(steps):
        angle = (F.coalesce(_month(F.get("yms", F.lit(h))), F.lit(1)) - 1) * (2 * np.pi / 12)
        lags = {f"lag{d}": F.get("path", F.lit(K + h - d)) for d in range(1, K + 1)}
        row = state.withColumns({"i": (F.col("start") + h).cast("double"), "sin": F.round(F.sin(angle), 9), "cos": F.round(F.cos(angle), 9), **lags})
        made = model.transform(pack.transform(row))
        state = made.withColumn("path", F.concat("path", F.array(F.col("lag1") + F.col("prediction")))).select(*kept)
    return state.withColumn("guesses", F.slice("path", K + 1, steps))


def forecast_trees(series: DataFrame, by: list[str], horizon: int = 6) -> DataFrame:
    """(by ..., ym, v, kind, model, rmse, mae, mape): errors of each candidate over the months held, and the months ahead by each.

    Months are of one row each, as in forecast.forecast(); null and NaN values
    count as 0, series of under 12 months have no row.  chosen() keeps the months
    ahead of the best candidate.
    """
    spark, horizon = series.sparkSession, max(1, min(horizon, LONGEST))
    types = dict(series.dtypes)
    rows = written(lag_rows(series, by), "lag-rows")
    learnt = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows.where(F.col("i") >= lag_months(F.col("n"))))
    if learnt.isEmpty():
        return spark.createDataFrame([], ", ".join([*[f"`{c}` {types[c]}" for c in by], "ym string, v double, kind string, model string, rmse double, mae double, mape double"]))
    held, whole = _state(rows, by, F.col("stop")), _state(rows, by, F.col("n"))
    day = F.to_date(F.concat("last", F.lit("-01")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda d: F.date_format(F.add_months(day, d), "yyyy-MM"))
    held, whole = written(held, "held"), written(whole.withColumn("yms", ahead), "whole")
    parts = []
    for name, fit in TREES.items():
        tried = recurse(fit().fit(learnt.where("i < stop")), held, HELD[1])
        pair = tried.select(*by, "level", F.explode(F.arrays_zip("truth", F.slice("guesses", F.lit(1), F.size("truth")).alias("guess"))).alias("p"))
        truth, guess = F.col("p.truth") * F.col("level"), F.col("p.guess") * F.col("level")
        told = pair.groupBy(*by).agg(*errors(truth, guess)).select(*by, F.lit(None).cast("string").alias("ym"), F.lit(None).cast("double").alias("v"), F.lit("model").alias("kind"), F.lit(name).alias("model"), "rmse", "mae", "mape")
        made = recurse(fit().fit(learnt), whole, horizon).select(*by, "level", F.explode(F.arrays_zip("yms", "guesses")).alias("p"))
        none = [F.lit(None).cast("double").alias(c) for c in ("rmse", "mae", "mape")]
        parts += [told, made.select(*by, F.col("p.yms").alias("ym"), (F.col("p.guesses") * F.col("level")).alias("v"), F.lit("future").alias("kind"), F.lit(name).alias("model"), *none)]
    return reduce(DataFrame.unionByName, parts)


def chosen(by: list[str], *made: DataFrame) -> DataFrame:
    """Rows of several forecasts of the same series: all candidates, and the months ahead of the one with the least error, which they carry.

    Of equal candidates the first of forecast.MODELS, then of TREES, wins.
    """
    order = F.create_map(*[F.lit(x) for k, m in enumerate([*MODELS, *TREES]) for x in (m, k)])
    rank = F.struct("rmse", order[F.col("model")].alias("k"), "model", "mae", "mape")
    both = reduce(DataFrame.unionByName, made).withColumn("best", F.min(F.when(F.col("kind") == "model", rank)).over(Window.partitionBy(*by)))
    kept = both.where((F.col("kind") == "model") | (F.col("model") == F.col("best.model")))
    return kept.select(*by, "ym", "v", "kind", "model", *[F.when(F.col("kind") == "model", F.col(c)).otherwise(F.col(f"best.{c}")).alias(c) for c in ("rmse", "mae", "mape")])
