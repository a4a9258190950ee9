"""An isolation forest over one column: values that few random cuts set apart are odd.

Each tree sees SAMPLE rows at most.  Its rows are ranks, drawn from a keyed
generator, of the column's values in order, so that the sample is the same
however Spark splits the rows.  Trees grow in tasks of their own.  Over one
column a tree is a step function, from the cuts in order to the path length
between them, and the forest is the sum of its trees': one array of cuts and one
of lengths, looked up for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Trees, rows of a tree, rows below which there is no forest, and the score above which a value is odd.
TREES, SAMPLE, FEWEST, ODD = 100, 256, 20, 0.5
_EULER = 0.5772156649015329


def expected(n: float | np.ndarray) -> np.ndarray:
    """Mean length of a failing search among ``n`` values: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + _EULER) - 2 * (many - 1) / many))


def drawn(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, trees): for each tree SAMPLE different ranks below ``n``, or all, by rank."""
    size = min(SAMPLE, n)
    each = [np.random.default_rng([seed, t]).choice(n, size, replace=False, shuffle=False) for t in range(TREES)]
    ranks, trees = np.concatenate(each), np.repeat(np.arange(TREES), size)
    order = np.argsort(ranks, kind="stable")
    return ranks[order], trees[order]


def grown(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """A tree over ``values`` as cuts in order and the path lengths below, between and above them; a value at a cut lies above it."""
    values = np.sort(values)
    most = int(np.ceil(np.log2(max(values.size, 2))))
    cuts: list[float] = []
    lengths: list[float] = []

    def grow(low: int, high: int, depth: int) -> None:
        if depth < most and high - low > 1 and values[low] < values[high - 1]:
            cut = float(rng.uniform(values[low], values[high - 1]))
            at = int(np.searchsorted(values, cut, "left"))
            if low < at < high:
                grow(low, at, depth + 1)
                cuts.append(cut)
                grow(at, high, depth + 1)
                return
        lengths.append(depth + float(expected(high - low)))

    grow(0, values.size, 0)
    return cuts, lengths


def summed(trees: list[tuple[list[float], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """All cuts in order, and the mean path length below, between and above them."""
    cut = np.concatenate([np.array(c, float) for c, _ in trees])
    step = np.concatenate([np.diff(lengths) for _, lengths in trees])
    order = np.argsort(cut, kind="stable")
    first = sum(lengths[0] for _, lengths in trees)
    return cut[order], np.concatenate(([first], first + np.cumsum(step[order]))) / len(trees)


def fit(upto: DataFrame, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The forest of ``n`` values, of which ``upto`` (value, n, upto) tells how many there are of each and up to each."""
    ranks, trees = drawn(n, seed)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column("upto").to_numpy()
            a, b = np.searchsorted(ranks, last - batch.column("n").to_numpy()), np.searchsorted(ranks, last)
            at = np.concatenate([np.arange(s, e) for s, e in zip(a.tolist(), b.tolist(), strict=True)] or [np.empty(0, int)]).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(trees[at], pa.int32()), pa.array(np.repeat(batch.column("value").to_numpy(), b - a), pa.float64())], ["tree", "value"])

    def grow(key: tuple, sample: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        cuts, lengths = grown(sample.column("value").to_numpy(), np.random.default_rng([seed, tree, 1]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "cuts": pa.array([cuts], pa.list_(pa.float64())), "lengths": pa.array([lengths], pa.list_(pa.float64()))})

    rows = upto.select("value", "n", "upto").mapInArrow(sampled, "tree int, value double")
    # TREES rows of at most SAMPLE cuts.
    made = rows.groupBy("tree").applyInArrow(grow, "tree int, cuts array<double>, lengths array<double>").orderBy("tree").collect()
    return summed([(r.cuts, r.lengths) for r in made])


def scores(value: Column | str, forest: tuple[np.ndarray, np.ndarray], n: int) -> Column:
    """From 0 to 1: the greater, the fewer cuts set the value apart."""
    cuts, lengths = forest
    usual = max(float(expected(min(SAMPLE, n))), 1e-12)

    @F.pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        path = lengths[np.searchsorted(cuts, values.to_numpy(float), "right")]
        return pd.Series(2.0 ** (-path / usual)).where(values.notna().to_numpy())

    return score(F.col(value).cast("double") if isinstance(value, str) else value)
