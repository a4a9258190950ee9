"""Dirty numbers, column names and the numeric vote, as Column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that may stand beside an amount.
CURRENCY_SIGNS = "$€£¥₩₹"
LONGEST_NUMBER, LONGEST_NAME, NAME_PART = 40, 80, 52
VOTE = 0.8


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` as the variable of an array function, so that it stands in the plan, and is computed, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_number(value: Column | str, strict: bool = False) -> Column:
    """A messy cell as a double, null if it is no number.

    Takes ``$ 100.00``, ``1,234.5``, ``1 234.5``, ``23%`` (23), ``(6.5)`` (-6.5)
    and ``-6.5 ( 6.5 )`` (-6.5).  Cells of over 40 characters, exponents, a
    leading ``+`` or a bare ``.5`` are no numbers.  As users of the older tool
    know it, ``(-6.5)`` is 6.5 and ``-1,234`` is no number; ``strict`` reads
    them as -6.5 and -1234.
    """
    sign = "-?" if strict else ""

    def read(text: Column) -> Column:
        wrapped = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
        inner = F.when(wrapped, F.trim(F.regexp_extract(text, r"(?s)^\((.*)\)$", 1))).otherwise(text)
        bare = F.translate(F.regexp_replace(F.trim(F.split(inner, r"\(", 2)[0]), "%$", ""), CURRENCY_SIGNS + " ", "")
        thousands = rf"^{sign}\d{{1,3}}(,\d{{3}})+(\.\d+)?$"
        plain = lambda t: F.when(t.rlike(thousands), F.translate(t, ",", "")).otherwise(t)
        number = _bound(_bound(bare, plain), lambda t: F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double")))
        turned = _bound(number, lambda x: F.when(wrapped, -F.abs(x) if strict else -x).otherwise(x))
        # No other character can begin a number, and most cells of a text column are told by it.
        begins = F.instr(F.lit("0123456789-( " + CURRENCY_SIGNS), F.left(text, F.lit(1))) > 0
        return F.when((F.length(text) > 0) & (F.length(text) <= LONGEST_NUMBER) & begins, turned)

    return _bound(F.regexp_replace(F.regexp_replace(F.trim(_column(value).cast("string")), "\u00a0", " "), "\u200b", ""), read)


def normalise_names(headers: list[str | None], width: int | None = None) -> list[str]:
    """Column names: white space collapsed, 80 characters at most, blanks as colN, repeats (case ignored) as name_2."""
    width = len(headers) if width is None else width
    padded = [*headers, *[None] * width][:width]
    taken: set[str] = set()
    out = []
    for place, header in enumerate(padded, 1):
        name = " ".join(str(header or "").replace("﻿", "").split())[:LONGEST_NAME].strip() or f"col{place}"
        options = (name if k == 1 else f"{name}_{k}" for k in range(1, width + 2))
        chosen = next(n for n in options if n.lower() not in taken)
        taken.add(chosen.lower())
        out.append(chosen)
    return out


def physical_name(source_id: str) -> str:
    """A stable table name: t_, readable characters of the id (CJK too), six digits of its md5."""
    readable = re.sub(r"[^\w一-鿿]+", "_", source_id).strip("_")[:NAME_PART]
    return f"t_{readable or 'tbl'}_{hashlib.md5(source_id.encode()).hexdigest()[:6]}"


def physical_name_column(source_id: Column | str) -> Column:
    source = _column(source_id)
    readable = F.left(F.regexp_replace(F.regexp_replace(source, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", ""), F.lit(NAME_PART))
    return F.concat(F.lit("t_"), F.when(readable == "", "tbl").otherwise(readable), F.lit("_"), F.left(F.md5(source), F.lit(6)))


def numeric_votes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (column, filled, numeric, is_numeric) for each text column, in one pass.

    A column is numeric if at least four fifths of its non-blank cells read as
    numbers, and two of them do, or its only one.
    """
    columns = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns])).alias("c")
    votes = df.select(cells).where("c.cell <> ''").groupBy("c.column").agg(F.count(F.lit(1)).alias("filled"), F.count(to_number("c.cell")).alias("numeric"))
    return votes.withColumn("is_numeric", (F.col("numeric") >= F.least(F.lit(2), F.col("filled"))) & (F.col("numeric") >= VOTE * F.col("filled")))


def coerce(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric columns as doubles; a ``<name>__raw`` column keeps cells that are no numbers where there are any to keep."""
    added = {}
    for c in numeric:
        cell = F.col(f"`{c}`")
        added[c] = to_number(cell)
        added[f"{c}__raw"] = F.when(to_number(cell).isNull() & (cell != ""), cell)
    return df.withColumns(added)
