"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its rows, which are counted, fit into so many bytes.
BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without the setting (tests, a laptop) gets a folder of
    its own; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; nothing is created."""
    return f"{shared_root(spark)}/geoloom/{name}-{uuid.uuid4().hex}"


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here,
    and a lost executor costs a read instead of a recomputation."""
    return _saved(df, fresh_folder(df.sparkSession, name))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def writing(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """Writes one file from the driver through the file system that owns it; parents are made.

    The file has its name only when the block has ended well.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.begun")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out, held = files.create(begun, True), bytearray()

    def write(data: bytes) -> None:
        held.extend(data)
        if len(held) > 1 << 16:
            out.write(held)
            held.clear()

    try:
        yield write
        out.write(held)
    except BaseException:
        out.close()
        files.delete(begun, False)
        raise
    out.close()
    files.delete(target, False)
    files.rename(begun, target)


def drop_written(df: DataFrame) -> None:
    """Deletes the folder of a table from :func:`written` that nobody reads again."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rpartition("/")[0])


class Scratch:
    """Written tables of one operator's run, which all go when the block ends.

    What the operator returns is written outside of it, or read from other tables.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, fresh_folder(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.folder)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _saved(df, f"{self.folder}/{self.n}-{name}")


def small(table: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A written table, to be broadcast if its rows, which are counted, take few bytes."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
