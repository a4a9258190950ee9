"""Readers for loose files: each gives a typed DataFrame with normalised names."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import coerce, normalise_names, numeric_votes
from ..operators.written import written

#: The encodings that are tried, in turn, and keys that hold the records of a JSON document.
ENCODINGS = ["utf-8", "gb18030", "big5", "latin-1"]
DELIMITERS = ["\t", ",", ";", "|"]
RECORD_KEYS = ["data", "records", "items", "rows", "result"]
SUFFIXES = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet", "xml": "xml"}


#: Lines that are looked at for the header, and bytes of the table of splits that a join may broadcast.
HEADED, SPLITS_BYTES = 200, 48 << 20


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the supported files of a folder, by name; lock files (``~$``) and empty files are left out."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    name, suffix = F.substring_index("path", "/", -1), F.lower(F.substring_index("path", ".", -1))
    return found.where(suffix.isin(*SUFFIXES) & ~name.startswith("~$")).orderBy(F.lower(name))


def _bad(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        try:
            # No encoding of the ladder takes a line end for a part of a character, so lines read together as they do alone.
            b"\n".join(batch.column(0).drop_null().to_pylist()).decode(encoding)
        except UnicodeDecodeError:
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["bad"])


def encoding_of(lines: DataFrame) -> str:
    """The first encoding of the ladder that reads every line of a column of bytes; all lines are looked at, once for each encoding that is tried."""
    for encoding in ENCODINGS[:-1]:
        if lines.mapInArrow(partial(_bad, encoding=encoding), "bad long").agg(F.count(F.lit(1))).first()[0] == 0:
            return encoding
    return ENCODINGS[-1]


@cache
def _closed(inside: bool, separator: str) -> re.Pattern:
    """A line at whose end no quoted cell is open, if one was (``inside``) or was not at its start."""
    mark = re.escape(separator)
    to_mark = rf"(?:(?!{mark})[\s\S])*+" if len(separator) > 1 else f"[^{mark}]*+"
    rest = rf'[^"]*+(?:""[^"]*+)*+"{to_mark}'
    cell = rf'(?: *+"{rest}|(?! *+"){to_mark})'
    return re.compile(rf"{rest}(?:{mark}{cell})*+" if inside else rf"{cell}(?:{mark}{cell})*+")


def ends_inside(line: str, inside: bool, separator: str) -> bool:
    """Whether a quoted cell is open at the end of a line, if one was (``inside``) or was not at its start.

    Only a quote at the start of a cell opens it; two quotes within are one.
    """
    return _closed(inside, separator).fullmatch(line) is None


def _decoded(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """((path, start of the split), lines, whether they may be of use for telling states) of runs of one split."""
    for batch in batches:
        lines, paths, starts = (batch.column(c).to_pylist() for c in ("line", "path", "start"))
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (paths[k], starts[k]) != (paths[first], starts[first]):
                yield (paths[first], starts[first]), [x.decode(encoding, "replace").removeprefix("\ufeff") for x in lines[first:k]], "inside" in batch.schema.names and batch.column("inside")[first].as_py()
                first = k


def _ends(batches: Iterator[pa.RecordBatch], encoding: str, separator: str) -> Iterator[pa.RecordBatch]:
    """(path, start, outside, inside): whether a quoted cell is open at the end of each split, if none or one was open at its start."""
    now, states = None, [False, True]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states)], ["path", "start", "outside", "inside"])

    for split, lines, _ in _decoded(batches, encoding):
        if split != now:
            if now:
                yield told()
            now, states = split, [False, True]
        for line in lines:
            if '"' in line:
                states = [ends_inside(line, s, separator) for s in states]
    if now:
        yield told()


def _starts(splits: pa.Table) -> pa.Table:
    """(path, start, inside) of the splits of one file: each state follows from the one before."""
    rows, inside = [], False
    for row in splits.sort_by("start").to_pylist():
        rows.append({"path": row["path"], "start": row["start"], "inside": inside})
        inside = row["inside" if inside else "outside"]
    return pa.Table.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_())]))


#: A record within a split; the rest of one that began in an earlier split; a part that neither begins nor ends here; one that goes on in the next split.
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def _records(batches: Iterator[pa.RecordBatch], encoding: str, separator: str, skip: int) -> Iterator[pa.RecordBatch]:
    """(record, path, start, kind) of each split, without the first ``skip`` records of a file; line ends within a record are ``\\n``."""
    now, left, held, opened = None, 0, [], False

    def batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([now[0]] * len(rows), pa.string()), pa.array([now[1]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32())], ["record", "path", "start", "kind"])

    for split, lines, inside in _decoded(batches, encoding):
        if split != now:
            if held:
                yield batch([("\n".join(held), MIDDLE if opened else TAIL)])
            now, left, held, opened, state = split, skip if split[1] == 0 else 0, [], inside, inside
        out = []
        for line in lines:
            held.append(line)
            state = ends_inside(line, state, separator) if state or '"' in line else False
            if not state:
                if left and not opened:
                    left -= 1
                else:
                    out.append(("\n".join(held), HEAD if opened else WHOLE))
                held, opened = [], False
        yield batch(out)
    if held:
        yield batch([("\n".join(held), MIDDLE if opened else TAIL)])


def _split_records(lines: DataFrame, encoding: str, separator: str, skip: int) -> DataFrame:
    """(record) of (line, path, start): lines of one record are joined, within a split and over splits of a file.

    A first pass tells how each split would leave a quoted cell; from that follows
    how each begins.  Files are read in splits, however large they are.
    """
    ends = written(lines.mapInArrow(partial(_ends, encoding=encoding, separator=separator), "path string, start long, outside boolean, inside boolean"), "split-ends")
    starts = written(ends.groupBy("path").applyInArrow(_starts, "path string, start long, inside boolean"), "split-starts")
    size = starts.agg(F.sum(F.octet_length("path") + 32), F.max("inside")).first()
    if (size[0] or 0) <= SPLITS_BYTES:
        known = lines.join(F.broadcast(starts), ["path", "start"])
    else:
        # Lines keep their order within a split through the shuffle.
        known = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "at").drop("at")
    records = known.select("line", "path", "start", "inside").mapInArrow(partial(_records, encoding=encoding, separator=separator, skip=skip), "record string, path string, start long, kind int")
    if not size[1]:
        return records.select("record")
    records = written(records, "records")
    # Two rows for each split at most.
    order = Window.partitionBy("path").orderBy("start", "kind")
    edges = records.where(F.col("kind") != WHOLE).withColumn("of", F.count_if(F.col("kind") == TAIL).over(order))
    joined = edges.groupBy("path", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return records.where(F.col("kind") == WHOLE).select("record").unionByName(joined.select("record"))


def delimiter_of(lines: list[str]) -> str:
    """The most frequent delimiter of the first line that has one."""
    return next((max(DELIMITERS, key=line.count) for line in lines if any(map(line.count, DELIMITERS))), ",")


def typed(df: DataFrame) -> DataFrame:
    """Normalised names, and text columns that are four fifths numbers as doubles."""
    named = df.toDF(*normalise_names(df.columns))
    text = [n for n, t in named.dtypes if t == "string"]
    numeric = [r["column"] for r in numeric_votes(named, text).where("is_numeric").collect()] if text else []  # one row a column
    return coerce(named, numeric) if numeric else named


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file, or files of one shape; delimiter and header are found from the first records, the encoding from all lines.

    Quoted cells may hold delimiters, doubled quotes and line ends, which become
    ``\\n``.  A title row above the header (at most one cell, or half as many as
    the next row) and the header are left out by their place, so a row that
    repeats them stays.  The header may be missing.  Blank rows are dropped.
    """
    # Spark keeps a line's bytes as they are, whatever the encoding.
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    encoding = encoding_of(lines.select("line"))
    # The first lines of the first file.
    head = [bytes(r[0]).decode(encoding, "replace").removeprefix("\ufeff") for r in lines.select("line").limit(HEADED).collect()]
    if not head:
        return spark.createDataFrame([], "col1 string")
    separator = delimiter_of(head)
    told = [[c.strip() for c in cells] for cells in islice(csv.reader((f"{line}\n" for line in head), delimiter=separator, skipinitialspace=True), 3)]
    filled = [sum(map(bool, cells)) for cells in told]
    titled = len(told) > 1 and (filled[0] <= 1 < filled[1] or 2 * filled[0] <= filled[1])
    cells = told[1 if titled else 0]
    has_names = any(c and not c.replace(".", "", 1).replace("-", "", 1).isdigit() for c in cells)
    names = normalise_names(cells if has_names else [None] * len(cells))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": separator, "mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    records = _split_records(lines, encoding, separator, titled + has_names)
    rows = records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    blank = F.forall(F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]), lambda c: c == "")
    return typed(rows.where(~blank))


def read_folder(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables of a folder's files by path, and what went wrong with those that can't be read; a bad file stops no other."""
    tables, failed = {}, {}
    for path in [r.path for r in discover(spark, folder).select("path").collect()]:
        try:
            tables[path] = read(spark, path)
        except Exception as error:  # any reader's, of any kind of file
            failed[path] = str(error).splitlines()[0][:200]
    return tables, failed


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON document or of JSON lines; a list under ``data``, ``records`` and so on is unwrapped, nested values become JSON text.

    Scalars, one for each line or in a list, are rows of a column ``value``.
    """
    df = spark.read.option("multiLine", not lines).json(path)
    if df.columns in ([], ["_corrupt_record"]):
        whole = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
        listed = F.concat(F.lit("["), F.col("value"), F.lit("]")) if lines else F.col("value")
        return typed(whole.select(F.explode(F.from_json(listed, "array<string>")).alias("value")))
    for name in RECORD_KEYS:
        kind = dict(df.dtypes).get(name, "")
        if kind.startswith("array<"):
            df = df.select(F.inline(name)) if kind.startswith("array<struct") else df.select(F.explode(name).alias("value"))
            break
    flat = [F.to_json(f"`{n}`").alias(n) if t.startswith(("struct", "array", "map")) else F.col(f"`{n}`") for n, t in df.dtypes]
    return typed(df.select(*flat))


_TAG = re.compile(r"<([^\s<>/!?]+)(?:\s[^<>]*)?/?>")


def row_tag_of(spark: SparkSession, path: str) -> str:
    """The tag of the first element below the root of an XML document."""
    # The beginning of a document is enough, and of a long line the beginning.
    head = spark.read.text(path).limit(HEADED).select(F.left("value", F.lit(1 << 16))).collect()
    text = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", "\n".join(r[0] for r in head), flags=re.S)
    tags = _TAG.findall(text)
    return tags[1] if len(tags) > 1 else "row"


def read(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Any supported file, by its suffix."""
    kind = SUFFIXES.get(path.rpartition(".")[2].lower())
    if kind == "csv":
        return read_delimited(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, kind == "jsonl")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df.toDF(*normalise_names(df.columns))
    if kind == "xml":
        return typed(spark.read.format("xml").option("rowTag", row_tag or row_tag_of(spark, path)).load(path))
    raise ValueError(f"no reader for {path}")


def markdown_rows(text: Column | str) -> Column:
    """array<array<string>>: cells of the pipe rows of a Markdown table, separator rows left out."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\||\|$", ""))
    return F.transform(bare, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))


def markdown_tables(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, cells): rows of each block's table from its header, row 0, on, padded or cut to the header's width."""
    rows = blocks.select(key, F.explode(F.array(markdown_rows(text))).alias("__rows")).where("size(__rows) >= 2")
    width = F.size(F.get("__rows", F.lit(0)))
    padded = F.transform("__rows", lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width))
    return rows.select(key, F.posexplode(padded).alias("row", "cells"))
