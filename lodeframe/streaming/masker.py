"""Masking of texts that arrive in pieces, in any order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.masking import ADDRESS_LABELS, NAME_LABELS, NUMBER_LABELS, TITLES, mask_free_text

#: Characters that wait for what follows, the most that may wait, and those that no pattern goes across.
WAITING, MOST = 64, 8192
BOUNDARIES = " \t\r\n,，。；;：:|、（）()【】[]「」\"'"
_BOUNDARY = re.compile(f"[{re.escape(BOUNDARIES)}]")
_ANNOUNCED = re.compile("(?:" + "|".join(sorted({*NUMBER_LABELS, *ADDRESS_LABELS, *NAME_LABELS, *TITLES}, key=len, reverse=True)) + r")\s*[:：]?\s*$")
#: Milliseconds after which a stream that has gone silent is given out as far as it came.
SILENT = 10 * 60 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def safe_cut(held: str) -> int:
    """How much of a text can go: up to the first boundary among its last characters that doesn't part a label from its value."""
    if len(held) <= WAITING:
        return 0
    ends = (m.end() for m in _BOUNDARY.finditer(held, len(held) - WAITING))
    free = next((e for e in ends if not _ANNOUNCED.search(held[max(0, e - 31) : e])), 0)
    return free or (len(held) if len(held) >= MOST else 0)


#: What a stream keeps: text that waits, the number of the next piece and of the next part, and pieces that came before their turn.
STATE = "held string, next int, part int, early array<struct<seq:int,chunk:string,last:boolean>>"


def _in_turn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, silent: int) -> Iterator[pd.DataFrame]:
    """Gives out what is safe of a stream, keeps the rest; a stream that was silent for too long ends with all there is."""
    held, turn, part, early = state.get if state.exists else ("", 0, 0, [])
    pieces = {p[0]: (p[1], p[2]) for p in early}
    if state.hasTimedOut:
        text = held + "".join(pieces[seq][0] for seq in sorted(pieces))
        state.remove()
        if text:
            yield pd.DataFrame({"stream": [key[0]], "part": np.array([part], np.int32), "text": [text]})
        return
    for frame in frames:
        for seq, chunk, last in zip(frame["seq"].tolist(), frame["chunk"].tolist(), frame["last"].tolist(), strict=True):
            # What was sent already, or comes again, is left out.
            if seq >= turn:
                pieces.setdefault(int(seq), (chunk or "", bool(last)))
    done = False
    while not done and turn in pieces:
        chunk, done = pieces.pop(turn)
        held, turn = held + chunk, turn + 1
    cut = len(held) if done else safe_cut(held)
    if done:
        if state.exists:
            state.remove()
    else:
        state.update((held[cut:], turn, part + bool(cut), [(seq, *piece) for seq, piece in sorted(pieces.items())]))
        state.setTimeoutDuration(silent)
    if cut:
        yield pd.DataFrame({"stream": [key[0]], "part": np.array([part], np.int32), "text": [held[:cut]]})


@contextmanager
def ending_with_data(spark: SparkSession) -> Iterator[None]:
    """Within this a query with the trigger ``availableNow`` ends when its data do; else it would go on for its timers."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def masked_stream(chunks: DataFrame, silent: int = SILENT) -> DataFrame:
    """(stream, part, text) of (stream, seq, chunk, last): masked text, as soon as it is safe to give out.

    Pieces are numbered from 0 within their stream and may come in any order,
    over any number of batches, and repeatedly; one that is before its turn
    waits.  The last piece in turn ends a stream and its state.  A stream that
    hears nothing for ``silent`` milliseconds ends with what there is, pieces that
    still wait at its end.  Of a table, each stream is one part.
    """
    if not chunks.isStreaming:
        told = chunks.dropDuplicates(["stream", "seq"]).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk")))).alias("x"))
        whole = told.select(F.col("stream").cast("long"), F.lit(0).alias("part"), F.array_join(F.transform("x", lambda p: p["chunk"]), "").alias("text"))
        return whole.where("text <> ''").withColumn("text", mask_free_text("text"))
    conf = chunks.sparkSession.conf
    # Streams by the million are kept outside of the heap.
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # State comes and goes with the rows, in Arrow batches, and not by calls for each stream.
    sent = chunks.select("stream", "seq", "chunk", "last").groupBy("stream").applyInPandasWithState(
        partial(_in_turn, silent=silent), "stream long, part int, text string", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return sent.where("text <> ''").withColumn("text", mask_free_text("text"))
