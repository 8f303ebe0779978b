"""Helpers that several operators need: tables in the shared folder, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..tables import Scratch, drop_written, fresh_folder, remove, shared_root, small, written

__all__ = ["Scratch", "drop_written", "fresh_folder", "pieces", "remove", "shared_root", "small", "small_batches", "written"]

#: One piece of an Arrow batch holds at most so many rows, and so many bytes of text unless one text has more.
PIECE_ROWS, PIECE_BYTES = 1024, 8 << 20
#: Arrow batches of steps that run at once, so that JVM and worker hold little beside the work.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few bytes for the steps that run in this block; the session's own setting comes back after it."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def pieces(batches: Iterable[pa.RecordBatch], *texts: str, rows: int = PIECE_ROWS, n_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces that are bounded by the bytes of these text columns.

    Spark bounds a batch by bytes, too; here the bound is one for the work on a
    batch, which takes a multiple of its texts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(x)), 0).to_numpy(zero_copy_only=False).astype("int64") for x in texts).tolist()
        begin, held = 0, 0
        for k, x in enumerate(sizes):
            if k > begin and (held + x > n_bytes or k - begin == rows):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += x
        yield batch.slice(begin)
