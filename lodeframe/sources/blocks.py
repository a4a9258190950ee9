"""Tables inside text dumps, and what a catalog keeps of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import physical_name_column
from .files import markdown_rows

LONGEST_CELL, LONGEST_BLOB = 500, 2000


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_cell(value: Column, dtype: str) -> Column:
    """A cell as text: nulls and NaN empty, dates as ISO, 500 characters at most."""
    if dtype in ("double", "float"):
        text = F.when(~F.isnan(value), value.cast("string"))
    elif dtype == "timestamp":
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = value.cast("string")
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.char_length(text) > LONGEST_CELL, F.concat(F.left(text, F.lit(LONGEST_CELL)), F.lit("…"))).otherwise(text)


def split_blocks(text: Column | str) -> Column:
    """array<struct<id, body>> of a dump whose blocks begin with a line ``=== id ===``."""
    mark = r"(?m)^===\s*(.+?)\s*===$"
    t = F.coalesce(_column(text), F.lit(""))
    ids, bodies = F.regexp_extract_all(t, F.lit(mark), F.lit(1)), F.split(t, mark)
    both = F.transform(ids, lambda i, at: F.struct(F.trim(i).alias("id"), F.get(bodies, at + 1).alias("body")))
    return F.filter(both, lambda b: b["id"] != "")


def fenced(body: Column | str) -> Column:
    """struct<lang, content> of the first code fence of a block; without one the whole block."""
    b = F.coalesce(_column(body), F.lit(""))
    fence = r"(?s)```([a-zA-Z]*)\s*\n(.*?)```"
    return F.struct(F.lower(F.regexp_extract(b, fence, 1)).alias("lang"), F.when(b.rlike(fence), F.regexp_extract(b, fence, 2)).otherwise(F.trim(b)).alias("content"))


def block_tables(dumps: DataFrame, text: str) -> DataFrame:
    """(id, kind, rows) of every block of text dumps that is a table: rows are arrays of cells, the header first.

    kind is ``markdown``; blocks with an HTML table have kind ``html`` and null rows.
    """
    each = dumps.select(F.explode(split_blocks(text)).alias("b")).select("b.id", fenced("b.body").alias("f"))
    html = F.col("f.lang").startswith("html") | F.lower(F.left("f.content", F.lit(2000))).contains("<table")
    rows = F.when(~html, markdown_rows("f.content"))
    out = each.select("id", F.when(html, "html").otherwise("markdown").alias("kind"), rows.alias("rows"))
    return out.where("kind = 'html' or size(rows) >= 2")


def search_blob(columns: list[str], df: DataFrame, order: str, values: int = 20) -> DataFrame:
    """One row (blob): column names, three rows, some short values of each column, and all of it with separators as blanks.

    Only the first rows by ``order`` are looked at; Spark keeps no more of them in a task.
    """
    first = df.orderBy(order).limit(10 * values)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = first.select(F.col(order).alias("__o"), F.array(*[text(c) for c in columns]).alias("r")).agg(F.array_sort(F.collect_list(F.struct("__o", "r"))).alias("x")).select(F.transform("x", lambda x: x["r"]).alias("x"))
    lines = F.transform(F.slice("x", 1, 3), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
    own = lambda k: F.transform("x", lambda r: F.get(r, F.lit(k)))
    short = [F.slice(F.filter(own(k), lambda v: (v != "") & (F.char_length(v) <= 30)), 1, values) for k in range(len(columns))]
    blob = F.left(F.array_join(F.concat(F.array(*[F.lit(c) for c in columns]), lines, *short), " | "), F.lit(LONGEST_BLOB))
    return rows.select(F.left(F.concat(blob, F.lit(" | "), F.regexp_replace(blob, r"[_./\-]+", " ")), F.lit(2 * LONGEST_BLOB)).alias("blob"))


def card(df: DataFrame, columns: list[str], most: int = 8) -> DataFrame:
    """(column, dtype, filled, distinct, samples): a data card; columns of few values list them all, others three samples."""
    types = dict(df.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("c")
    counts = df.select(cells).select("c.*").groupBy("column", "dtype", "value").agg(F.count(F.lit(1)).alias("n"))
    # Values are counted first; each task then hands on the least of them only.
    least = F.array_sort(F.collect_list("value"))
    ranked = counts.where("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("k") <= most)
    few = ranked.groupBy("column").agg(least.alias("least"))
    sums = counts.groupBy("column", "dtype").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("value").alias("distinct"))
    joined = sums.join(few, "column", "left")
    return joined.select("column", "dtype", "filled", "distinct", F.when(F.col("distinct") <= most, F.col("least")).otherwise(F.slice("least", 1, 3)).alias("samples"))


def catalog(tables: dict[str, DataFrame], dataset: str) -> DataFrame:
    """(dataset, source, name, columns, n_rows) of some tables, by source id."""
    one = lambda source, df: df.agg(F.lit(dataset).alias("dataset"), F.lit(source).alias("source"), physical_name_column(F.lit(source)).alias("name"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.count(F.lit(1)).alias("n_rows"))
    out = None
    for source, df in tables.items():
        out = one(source, df) if out is None else out.unionByName(one(source, df))
    return out


def resolve(entries: DataFrame, wanted: str) -> DataFrame:
    """The entry of a catalog() that a name means: by table name, by source, or by a part of the source; the best one."""
    low = wanted.lower()
    rank = F.when(F.col("name") == wanted, 0).when(F.col("source") == wanted, 1).when(F.lower("source").contains(low) | F.lower("name").contains(low), 2)
    return entries.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "source").limit(1).drop("__rank")


def with_column_like(entries: DataFrame, part: str) -> DataFrame:
    """Entries of a catalog() with a column whose name has ``part`` in it, in any case."""
    return entries.where(F.exists("columns", lambda c: F.lower(c).contains(part.lower())))
