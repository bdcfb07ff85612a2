"""Helpers of the operators in this subpackage."""

import pickle
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a slice of an Arrow batch that a task handles at once.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20


def worker_store(owner: str) -> dict:
    """A dictionary that outlives a task in its Python worker, for what is dear to load.

    A worker keeps that of one owner at a time, so that jobs which follow each other don't add up
    what they keep.
    """
    name = "feedbackmill_worker_store"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if owner not in kept:
        kept.clear()
    return kept.setdefault(owner, {})


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send a value of bounded size to all executors; tasks call the result to get it.

    Its classes travel along, so that executors need not have this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes, so that long texts don't pile up.

    A slice holds at least one row; empty batches give none.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = min(max(stop, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3; null ids are kept."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, rows: int, max_bytes: int, max_text_share: float = 0.01
) -> list[tuple[str, object]]:
    """(text, label) of at most ``rows`` documents, picked by a hash of the id.

    ``docs`` gives doc_id and text, ``labels`` doc_id and label. Rows with a null text or label or
    of the held-out third are left out; of several labels of an id the largest counts. Ids and
    sizes are read first, texts only of those chosen. Texts above ``max_text_share`` of ``max_bytes``
    come after all others, and one that would pass ``max_bytes`` in all is skipped. So what reaches
    the driver is bounded by rows and bytes, whatever the size of the input, and a few very long
    texts don't take the place of many.
    """
    named = labels.where(F.col("label").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    pool = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = pool.select("doc_id", F.octet_length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    long = F.col("size") > int(max_bytes * max_text_share)
    heads = (
        sizes.join(named, "doc_id").orderBy(long, F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(rows).collect()
    )
    chosen, total = {}, 0
    for row in heads:
        if total + row["size"] > max_bytes:
            continue
        total += row["size"]
        chosen[row["doc_id"]] = row["label"]
    if not chosen:
        return []
    texts = pool.where(F.col("doc_id").isin(*chosen)).groupBy("doc_id").agg(F.max("text").alias("text"))
    return [(r["text"], chosen[r["doc_id"]]) for r in sorted(texts.collect(), key=lambda r: r["doc_id"])]
