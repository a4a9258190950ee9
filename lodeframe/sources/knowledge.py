"""Text files of a folder as chunks with their metadata, and an index of them that follows the folder.

The index keeps what each file adds: its chunks and their token counts.  A
refresh lists the folder, compares sizes and times, reads only new and changed
files, takes the old counts of changed and removed ones out of the document
frequencies and puts the new ones in.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import headings, tokens
from ..operators.chunks import chunks
from ..operators.retrieval import best, inverse_frequency, tfidf_of
from ..operators.written import written
from ..streaming.keyed import KeyedTable
from ..streaming.sync import changes
from .files import ENCODINGS

#: Suffixes of knowledge files, and bytes above which a file is left out.
SUFFIXES, LARGEST = ["md", "markdown", "txt"], 20 * 1024 * 1024
#: Changed files that are named to Spark one by one; of more, the folder is read and the others are left out.
NAMED = 1000


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, length, modified) of a folder's knowledge files and those of all folders below it, without hidden ones.

    ``source`` is the path from the folder on.  Names that begin with ``_`` are
    hidden to Spark, as those with ``.`` are, and empty files are left out.
    """
    return _sources(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), folder).drop("content")


def _sources(files: DataFrame, folder: str) -> DataFrame:
    root = re.sub(r"^\w+:/*", "", folder).strip("/")
    source = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), "^/?" + re.escape(root) + "/", "")
    kept = files.where(F.lower(F.substring_index("path", ".", -1)).isin(SUFFIXES) & (F.col("length") <= LARGEST))
    return kept.select(source.alias("source"), "path", "length", F.col("modificationTime").alias("modified"), "content").where(~F.col("source").rlike(r"(^|/)\."))


@F.pandas_udf(StringType())
def _text(contents: pd.Series) -> pd.Series:
    """Each file by the first encoding of the ladder that reads it; the last reads all."""

    def one(raw: bytes) -> str:
        for name in ENCODINGS:
            try:
                return bytes(raw).decode(name).removeprefix("﻿")
            except UnicodeDecodeError:
                continue
        return ""

    return contents.map(one)


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """(source, updated, page, chunk_index, chunk, ref) of all knowledge files; ``updated`` is the day of the last change, ``page`` null for text."""
    files = _sources(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), folder)
    return _chunked(files)


def _chunked(files: DataFrame) -> DataFrame:
    docs = files.select("source", F.date_format("modified", "yyyy-MM-dd").alias("updated"), F.lit(None).cast("int").alias("page"), _text("content").alias("text"))
    return chunks(docs, "source", "text")


def routing_keywords(files: DataFrame) -> DataFrame:
    """(source, keyword) of (source, text): the file's name without its suffix, and its headings of the first two levels."""
    name = F.regexp_replace(F.substring_index("source", "/", -1), r"\.[^.]*$", "")
    words = F.array_distinct(F.filter(F.transform(F.concat(F.array(name), headings("text")), lambda w: F.trim(w)), lambda w: w != ""))
    return files.select("source", F.explode(words).alias("keyword"))


_TERMS = "array<struct<token:string,tf:long>>"


class KnowledgeIndex:
    """An index under ``root`` of the knowledge files of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, root: str, buckets: int = 16) -> None:
        self.spark, self.folder = spark, folder
        self.files = KeyedTable(spark, f"{root}/files", "source", f"source string, signature string, chunks array<struct<ref:string,chunk:string,terms:{_TERMS}>>", buckets)
        self.terms = KeyedTable(spark, f"{root}/terms", "token", "token string, df long", buckets)

    def _contents(self, wanted: DataFrame) -> DataFrame:
        """Contents of the wanted files (source, path) alone."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        named = [r.path for r in wanted.select("path").limit(NAMED + 1).collect()]
        files = reader.load(named if len(named) <= NAMED else self.folder)
        return _sources(files, self.folder).join(wanted.select("source"), "source", "left_semi")

    def _analysed(self, wanted: DataFrame) -> DataFrame:
        """(source, chunks) with each chunk's token counts; a file without text has no chunk."""
        cut = _chunked(self._contents(wanted)).select("source", "ref", "chunk")
        split = cut.select("source", "ref", F.explode(tokens("chunk")).alias("token")).groupBy("source", "ref", "token").agg(F.count(F.lit(1)).alias("tf"))
        # A chunk has some hundred characters.
        counted = split.groupBy("source", "ref").agg(F.array_sort(F.collect_list(F.struct("token", "tf"))).alias("terms"))
        whole = cut.join(counted, ["source", "ref"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(_TERMS)))
        # A file has 20 MB at most.
        return whole.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ref", "chunk", "terms"))).alias("chunks"))

    @staticmethod
    def _frequencies(files: DataFrame, sign: int) -> DataFrame:
        """(token, d): ``sign`` for each chunk of ``files`` that has the token."""
        terms = files.select(F.explode("chunks").alias("c")).select(F.explode("c.terms").alias("t"))
        return terms.groupBy(F.col("t.token").alias("token")).agg((F.count(F.lit(1)) * sign).alias("d"))

    def refresh(self) -> dict[str, int]:
        """Take in what changed in the folder since the last refresh; the number of files written and removed.

        If an earlier refresh ended between the two tables, the frequencies are
        counted anew from the files' own counts.
        """
        version, held = self.files.slots.read()[0], self.terms.slots.read()[0]
        if version != held:
            self.terms.apply(self._settled(self._frequencies(self.files.read(), 1).withColumnRenamed("d", "df")), version, gone="gone")
        signature = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modified").cast("string"))
        listed = written(walk(self.spark, self.folder).select("source", "path", signature.alias("signature")), "listed")
        known = self.files.read()
        told = written(changes(known.select("source", "signature"), listed.select("source", "signature"), "source", ["signature"]).where("change <> 'unchanged'"), "told")
        counts = {r.change: r.n for r in told.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return {"written": 0, "removed": 0}
        new = listed.join(told.where("change = 'written'").select("source"), "source", "left_semi")
        read = self._analysed(written(new, "new")) if counts.get("written") else known.limit(0).select("source", "chunks")
        own = written(new.join(read, "source", "left").select("source", "signature", F.coalesce("chunks", F.array().cast(known.schema["chunks"].dataType)).alias("chunks")), "own")
        old = known.join(told.select("source"), "source", "left_semi")
        delta = self._frequencies(old, -1).unionByName(self._frequencies(own, 1)).groupBy("token").agg(F.sum("d").alias("d")).where("d <> 0")
        # Read before the files' table moves on.
        moved = written(delta.join(self.terms.read(), "token", "left").select("token", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df")), "moved")
        gone = told.where("change = 'removed'").select("source", F.lit(None).cast("string").alias("signature"), F.lit(None).cast(known.schema["chunks"].dataType).alias("chunks"), F.lit(True).alias("gone"))
        self.files.apply(own.withColumn("gone", F.lit(False)).unionByName(gone), version + 1, gone="gone")
        self.terms.apply(moved.withColumn("gone", F.col("df") <= 0), version + 1, gone="gone")
        return {"written": counts.get("written", 0), "removed": counts.get("removed", 0)}

    def _settled(self, counted: DataFrame) -> DataFrame:
        """All frequencies as they should be, those that are no more marked ``gone``."""
        old = self.terms.read().select("token")
        return counted.join(old, "token", "full").select("token", "df", F.col("df").isNull().alias("gone"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, key, score, place) of the chunks, as best(tfidf()) of them; ``key`` is a chunk's ref."""
        parts = self.files.read().select(F.explode("chunks").alias("c"))
        counts = parts.select(F.col("c.ref").alias("key"), F.explode("c.terms").alias("t")).select("key", "t.token", "t.tf")
        n = parts.agg(F.count(F.lit(1)).alias("__n"))  # one row
        return best(tfidf_of(counts, inverse_frequency(self.terms.read(), n), queries), k)
