"""Trees over many series against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lodeframe.operators import forecast, trees

MONTHS = [f"{2015 + m // 12}-{m % 12 + 1:02d}" for m in range(60)]


def value(s: int, m: int) -> float:
    return float((s + 1) * 10 * (50 + m + 20 * np.sin(2 * np.pi * (m % 12) / 12)))


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, ym, value(s, m)) for s in range(6) for m, ym in enumerate(MONTHS)]
    rows += [(None, ym, value(2, m)) for m, ym in enumerate(MONTHS[:12])] + [(99, ym, 1.0) for ym in MONTHS[:11]] + [(50, ym, None) for ym in MONTHS[:20]]
    return spark.createDataFrame(rows, "s int, ym string, v double").repartition(3)


def test_months_held_and_lags(spark):
    rows = spark.range(12, 200).select(F.col("id").cast("int").alias("n"))
    for r in rows.select("n", trees.lag_months(F.col("n")).alias("k"), trees.held_months(F.col("n")).alias("h")).collect():
        assert (r.k, r.h) == (forecast.lag_count(r.n), forecast.held_count(r.n))


def test_recursion_is_a_plain_loop(series):
    rows = trees.lag_rows(series, ["s"]).cache()
    learnt = VectorAssembler(inputCols=trees.INPUTS, outputCol="features").transform(rows)
    model = trees.TREES["boosted"]().fit(learnt)
    state = trees._state(rows, ["s"], F.col("stop"))
    own = {}
    for r in rows.collect():
        own.setdefault(r.s, {})[r.i] = r
    for r in trees.recurse(model, state, 4).collect():
        mine = own[r.s]
        values = [mine[i].v for i in range(r.start)]
        for h in range(min(4, len(r.truth))):
            angle = 2 * np.pi * (int(mine[r.start + h].ym[5:7]) - 1) / 12
            lags = [values[-d] if d <= len(values) else 0.0 for d in range(1, trees.K + 1)]
            values.append(lags[0] + model.predict(Vectors.dense([len(values), round(np.sin(angle), 9), round(np.cos(angle), 9), *lags])))
            assert r.guesses[h] == pytest.approx(values[-1], abs=1e-9) and r.truth[h] == mine[r.start + h].v


def test_forecasts(series):
    made = trees.forecast_trees(series, ["s"], 12).cache()
    rows = made.collect()
    assert {r.s for r in rows} == {0, 1, 2, 3, 4, 5, None, 50}
    tried = {(r.s, r.model): r for r in rows if r.kind == "model"}
    assert len(tried) == 16 and all(r.rmse >= r.mae >= 0 for r in tried.values())
    ahead = [r for r in rows if r.kind == "future"]
    assert len(ahead) == 8 * 2 * 12 and {r.v for r in ahead if r.s == 50} <= {r.v for r in ahead}
    # A trend goes on and the season turns, beyond all values seen, for every level.
    for r in ahead:
        if r.s is not None and r.s < 6:
            m = 60 + [f"{2020 + k // 12}-{k % 12 + 1:02d}" for k in range(12)].index(r.ym)
            assert r.v == pytest.approx(value(r.s, m), rel=0.2)
    both = trees.chosen(["s"], forecast.forecast(series.where("v is not null"), ["s"], 12), made).collect()
    for s in (None, 0, 5):
        own = [r for r in both if r.s == s]
        errors = {r.model: r.rmse for r in own if r.kind == "model"}
        assert set(errors) == {*forecast.MODELS, *trees.TREES}
        best = min(errors, key=errors.get)
        assert [(r.model, r.rmse) for r in own if r.kind == "future"] == [(best, errors[best])] * 12


def test_no_series(spark):
    none = spark.createDataFrame([], "s string, ym string, v double")
    assert trees.forecast_trees(none, ["s"]).collect() == []
    short = spark.createDataFrame([("a", ym, 1.0) for ym in MONTHS[:11]], "s string, ym string, v double")
    assert trees.forecast_trees(short, ["s"]).columns == ["s", *trees.OUT] and trees.forecast_trees(short, ["s"]).isEmpty()
