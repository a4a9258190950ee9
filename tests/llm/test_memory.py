"""What Python workers hold at once, and what they keep from task to task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkContext

from lodeframe.llm import packing, setjoin, toxicity
from lodeframe.llm.storage import BATCH_BYTES, in_batches
from lodeframe.llm.tokens import encoder


def test_packed_rows_leave_some_at_a_time():
    """Many more rows than a batch holds: none is lost, batches stay small, and so does what stands beside the rows."""
    rng = np.random.default_rng(7)

    def part(n: int) -> pa.RecordBatch:
        long = lambda: pa.array(rng.integers(0, 1 << 62, n))
        size = (rng.integers(4, 300, n) << 32) | rng.integers(0, 9, n)
        return pa.RecordBatch.from_arrays([long(), long(), pa.array(rng.integers(0, 1 << 30, n).astype(np.int32)), pa.array(size), long(), long(), long(), long()], setjoin.PREFIX)

    given: list[np.ndarray] = []

    def parts():
        for n in [1 << 15] * 17 + [5]:
            made = part(n)
            given.append(np.sort(made.column("key").to_numpy() ^ made.column("size").to_numpy() ^ made.column("b3").to_numpy()))
            yield made

    got, most = [], 0
    tracemalloc.start()
    for batch in setjoin.packed(parts(), 400):
        most = max(most, batch.nbytes)
        for count, data in zip(batch.column("rows").to_pylist(), batch.column("data"), strict=True):
            cols = setjoin._unpacked_rows(data.as_py(), count)
            got.append(cols["key"] ^ cols["size"] ^ cols["b3"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.sort(np.concatenate(got)), np.sort(np.concatenate(given)))
    assert most <= 1.1 * BATCH_BYTES
    # Without the rows' digests, which this test keeps itself.
    assert peak - sum(x.nbytes for x in (*got, *given)) < 80e6


class Frame:
    """Stands for a DataFrame; gives back the function that its tasks would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_tokenizers_stay_for_tasks_that_encode_alone(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    first = encoder(path)
    assert list(packing.pieces(Frame(spark), path)(iter([]))) == []
    assert encoder(path) is first
    assert list(in_batches(Frame(spark), iter, "a long")(iter([]))) == []
    assert encoder(path) is not first


def test_the_sample_is_sent_without_python_workers(spark, smallest, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("rows went through Python workers of their own")

    docs, labels = (spark.read.parquet(f"{smallest}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(SparkContext, "parallelize", never)
    assert toxicity.train(docs, labels).weight.any()


@pytest.mark.parametrize("labelled", [0, 1])
def test_training_on_few_labels(spark, labelled):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(1, 9)], "doc_id long, toxic int").limit(8 * labelled)
    assert not toxicity.train(docs, labels).weight.any()
