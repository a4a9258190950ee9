"""Comparing results: multisets of rows, and numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame) -> DataFrame:
    """Every column as text that is equal for equal values: numbers without trailing zeros, dates as ISO, nulls marked."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("decimal", "double", "float")) or kind in ("int", "bigint", "smallint", "tinyint"):
            text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        elif kind == "binary":
            text = F.hex(c)
        else:
            text = c.cast("string")
        out.append(F.coalesce(text, F.lit("\u0000null")).alias(name))
    return df.select(*out)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, counted, that one side holds more often than the other: (side, columns..., n)."""
    only = lambda a, b, side: a.exceptAll(b).groupBy(*left.columns).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), *left.columns, "n")
    right = right.toDF(*left.columns)
    return only(left, right, "left").unionByName(only(right, left, "right"))


def same(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows equally often, in any order."""
    return len(left.columns) == len(right.columns) and differences(canonical(left), canonical(right)).limit(1).count() == 0


def numbers_in(text: Column | str) -> Column:
    """Numbers in a text as array<double>; 亿, 万, 千 multiply, % is left as it stands."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(-?\d+(?:\.\d+)?\s*[亿万千%]?)"), F.lit(1))
    scale = lambda t: F.when(t.endswith("亿"), 1e8).when(t.endswith("万"), 1e4).when(t.endswith("千"), 1e3).otherwise(1.0)
    return F.transform(found, lambda t: F.regexp_extract(t, r"-?\d+(\.\d+)?", 0).cast("double") * scale(t))


def number_matches(answer: Column | str, truth: Column | str) -> Column:
    """Whether a text gives ``truth``, as it is or rounded, by ten thousands or by hundred millions, within half a unit or half a percent."""
    t = F.col(truth) if isinstance(truth, str) else truth
    forms = [t, *(F.bround(t, n) for n in (2, 1, 0)), t / 1e4, *(F.bround(t / 1e4, n) for n in (2, 1)), t / 1e8, F.bround(t / 1e8, 2)]
    near = lambda v, c: F.abs(v - c) <= F.greatest(F.lit(0.5), F.abs(c) * 0.005)
    return F.exists(numbers_in(answer), lambda v: F.exists(F.array(*forms), lambda c: near(v, c)))
