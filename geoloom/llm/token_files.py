"""Token ids of documents in wavelet-matrix shard files, written and read back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import TOGETHER, TOGETHER_BYTES, encoder
from .shared import fresh_folder, pieces, small_batches, written
from .wavelet import from_bytes, to_bytes

SHARD_TOKENS = 1 << 21
NO_ID = -(1 << 63)
SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, file string"
TOKEN_SCHEMA = "part int, shard int, place int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shard files in ascending doc_id order.

    One row a file: part, shard, n_docs, n_tokens, file.  Range partitioning by
    doc_id gives each task a run of ids; it closes a file at ``shard_tokens``, so
    memory holds one file's ids and one text.  A file has its final name only
    when it is whole, and the name depends on the part and shard alone: a task
    that runs again replaces its own files by equal ones.

    Null texts count as empty: only the end id.  Equal doc_ids all stay, ordered
    by their text.  Rows without a doc_id come first, and read back without one; the
    least 64-bit number stands for it in the files.  Empty tables write none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    # Equal ids must meet, and stand in one order, so the range is over the id alone.
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = [] if end_id is None else [end_id]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        tail = np.array(end, dtype=tool.dtype).tobytes()
        levels = 8 * tool.dtype.itemsize
        ids, doc_ids, lengths, held, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{root}/part-{part:06d}-{shard:06d}.wm"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(begun := f"{root}/.{uuid.uuid4().hex}.begun") as out:
                out.write(to_bytes(doc_ids, lengths, np.frombuffer(b"".join(ids), dtype=tool.dtype), levels))
            store.move(begun, name)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": [len(doc_ids)], "n_tokens": [held], "file": [name]})

        for batch in pieces(batches, "text", rows=TOGETHER, n_bytes=TOGETHER_BYTES):
            encoded, bounds = tool.encode_many(batch.column("text").to_pylist())
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids.append(encoded[bounds[k] : bounds[k + 1]].tobytes() + tail)
                doc_ids.append(doc_id)
                lengths.append(len(ids[-1]) // tool.dtype.itemsize)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield close()
                    ids, doc_ids, lengths, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    return ordered.mapInArrow(write, SHARD_SCHEMA)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document of the files: its place, offset, length and checksum."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                part, shard = map(int, path.rpartition("/")[2][5:-3].split("-"))
                doc_ids, starts, lengths, matrix = from_bytes(content)
                ids = matrix.decode().astype("<u4")
                spans = zip(starts.tolist(), lengths.tolist(), strict=True)
                yield pd.DataFrame({"part": part, "shard": shard, "place": np.arange(len(doc_ids)), "doc_id": pd.arrays.IntegerArray(doc_ids.astype("int64"), doc_ids == NO_ID), "offset": starts.astype("int64"), "n_tokens": lengths.astype("int64"), "ids_crc32": [zlib.crc32(ids[a : a + n]) for a, n in spans]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder)
    return files.select("path", "content").mapInPandas(read, TOKEN_SCHEMA)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files, reads them back, and numbers the whole stream.

    doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, file.
    Starts come from two levels of sums: over the shards of a part, and over the
    parts, of which there are as many as range partitions.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "token-files")
    with small_batches(spark):
        shards = written(write_token_files(docs, tokenizer_path, folder, end_id, shard_tokens), "token-shards")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    before = Window.unboundedPreceding
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # One row for each range partition, so this window's single task is small.
    bases = parts.select("part", (F.sum("tokens").over(Window.orderBy("part").rowsBetween(before, 0)) - F.col("tokens")).alias("part_base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(before, 0)) - F.col("n_tokens")
    first = shards.withColumn("within", within).join(bases, "part").select("part", "shard", (F.col("part_base") + F.col("within")).alias("base"), F.element_at(F.split("file", "/"), -1).alias("file"))
    return read_token_files(spark, folder).join(first, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "file")
