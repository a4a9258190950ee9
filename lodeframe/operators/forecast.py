"""Forecasts of monthly series: lag features, walk-forward choice of a model, recursion into the future.

A series has one number for each month, some hundreds at most, so a whole series
is one group and Spark spreads the series; rows are summed to months before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest months, longest horizon, and the bounds of the lags and of the months held back.
FEWEST, LONGEST, LAGS, HELD = 12, 24, (3, 12), (4, 12)


def lag_count(n: int) -> int:
    return min(LAGS[1], max(LAGS[0], n // 6))


def held_count(n: int) -> int:
    """Months held back for validation: a sixth, fewer where too few would be left to learn from."""
    most = max(HELD[0], min(HELD[1], n // 6))
    return min(most, max(2, n - lag_count(n) - 10))


def features(series: DataFrame, by: list[str], k: int) -> DataFrame:
    """``series`` (by ..., ym, v) with i (months so far), sin and cos of the month, and lag1 .. lagk, 0 where there is none.

    A window for each series, whose rows are months.
    """
    w = Window.partitionBy(*by).orderBy("ym")
    month = (F.substring("ym", 6, 2).cast("int") - 1) * (2 * np.pi / 12)
    lags = {f"lag{d}": F.coalesce(F.lag("v", d).over(w), F.lit(0.0)) for d in range(1, k + 1)}
    return series.withColumns({"i": F.row_number().over(w) - 1, "sin": F.sin(month), "cos": F.cos(month), **lags})


def errors(truth: Column, guess: Column) -> list[Column]:
    """Aggregates rmse, mae and mape (in percent) of guesses."""
    off = F.abs(truth - guess)
    return [F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("mae"), (100 * F.avg(off / F.greatest(F.abs(truth), F.lit(1e-9)))).alias("mape")]


def complete_months(series: DataFrame, by: list[str]) -> DataFrame:
    """``series`` with the months that are missing between its first and last, as 0."""
    day = F.to_date(F.concat("ym", F.lit("-01")))
    span = series.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = span.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(*by, F.date_format("d", "yyyy-MM").alias("ym"))
    return every.join(series, [*by, "ym"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def _row(i: int, values: list[float], month: int, k: int) -> list[float]:
    lags = [values[i - d] if i >= d else 0.0 for d in range(1, k + 1)]
    angle = 2 * np.pi * (month - 1) / 12
    return [float(i), np.sin(angle), np.cos(angle), *lags]


def _linear(x: np.ndarray, y: np.ndarray, penalty: float) -> Callable[[np.ndarray], np.ndarray]:
    """Least squares on standardised columns; ``penalty`` shrinks all weights but the mean."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = (x - mean) / std
    if penalty:
        weight = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    else:
        weight = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    return lambda new: (new - mean) / std @ weight + y.mean()


def _kernel(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Ridge regression with a radial kernel, on standardised columns and values."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z, scale = (x - mean) / std, y.std() or 1.0
    near = lambda a: np.exp(-((a[:, None, :] - z[None, :, :]) ** 2).sum(2) / x.shape[1])
    weight = np.linalg.solve(near(z) + np.eye(len(z)), (y - y.mean()) / scale)
    return lambda new: near((new - mean) / std) @ weight * scale + y.mean()


#: The candidates, in order; the first of equals wins.
MODELS: dict[str, Callable] = {"linear": lambda x, y: _linear(x, y, 0.0), "ridge": lambda x, y: _linear(x, y, 1.0), "kernel": _kernel}


def _recurse(model: Callable, values: list[float], months: list[int], k: int) -> list[float]:
    """Guesses for ``months``, each of which is a value for those after it."""
    now = list(values)
    for month in months:
        now.append(float(model(np.array([_row(len(now), now, month, k)]))[0]))
    return now[len(values) :]


def forecast_one(yms: list[str], values: list[float], horizon: int) -> pd.DataFrame:
    """Rows (ym, v, kind, model, rmse, mae, mape) of one series: ``model`` for each candidate, ``future`` for each month ahead."""
    n, k, horizon = len(values), lag_count(len(values)), max(1, min(horizon, LONGEST))
    names = ["ym", "v", "kind", "model", "rmse", "mae", "mape"]
    if n < FEWEST:
        return pd.DataFrame([], columns=names)
    months = [int(ym[5:7]) for ym in yms]
    stop = n - held_count(n)
    x = np.array([_row(i, values, months[i], k) for i in range(k, n)])
    y = np.array(values[k:])
    rows = []
    for name, fit in MODELS.items():
        guess = np.array(_recurse(fit(x[: stop - k], y[: stop - k]), values[:stop], months[stop:], k))
        off = np.abs(np.array(values[stop:]) - guess)
        rows.append((None, None, "model", name, float(np.sqrt((off**2).mean())), float(off.mean()), float(100 * (off / np.maximum(np.abs(values[stop:]), 1e-9)).mean())))
    best = min(rows, key=lambda r: r[4])
    last = pd.Period(yms[-1], "M")
    ahead = [last + d for d in range(1, horizon + 1)]
    future = _recurse(MODELS[best[3]](x, y), values, [p.month for p in ahead], k)
    rows += [(str(p), v, "future", *best[3:]) for p, v in zip(ahead, future, strict=True)]
    return pd.DataFrame(rows, columns=names)


def forecast(series: DataFrame, by: list[str], horizon: int = 6) -> DataFrame:
    """(by ..., ym, v, kind, model, rmse, mae, mape) for every series of ``series`` (by ..., ym, v); those of under 12 months have no row."""
    types = dict(series.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ym")
        out = forecast_one(rows["ym"].tolist(), rows["v"].astype(float).tolist(), horizon)
        for k, c in enumerate(by):
            out.insert(k, c, key[k])
        return out

    return series.groupBy(*by).applyInPandas(run, f"{head}, ym string, v double, kind string, model string, rmse double, mae double, mape double")


def report(series: DataFrame, made: DataFrame, by: list[str]) -> DataFrame:
    """Months of history and of the forecast in one table, with the change to the month before and in percent (0 after a 0)."""
    history = series.select(*by, "ym", F.col("v").cast("double").alias("v"), F.lit("history").alias("kind"))
    both = history.unionByName(made.where("kind = 'future'").select(*by, "ym", "v", "kind"))
    before = F.lag("v").over(Window.partitionBy(*by).orderBy("ym"))
    return both.withColumn("diff", F.col("v") - before).withColumn("pct", F.when(before == 0, 0.0).otherwise((F.col("v") - before) * 100.0 / before))
