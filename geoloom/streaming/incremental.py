"""Incremental manifests: arriving records against what was accepted before.  An extension.

Greedy deduplication never changes an earlier decision for a later row, so a
batch is decided against the rows accepted so far and those of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, spatial
from ..tables import exists


def decide(accepted: DataFrame, arriving: DataFrame, radius_m: float = 7.0, max_per_cluster: int = 2) -> DataFrame:
    """The rows of ``arriving`` (with ``ord`` after all accepted ones) that are kept.

    Accepted rows stay as they are; of them only those near an arriving row are looked at.
    """
    return spatial.deduplicate(arriving, radius_m, max_per_cluster, accepted=accepted)


def stream_manifest(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, radius_m: float = 7.0, max_per_cluster: int = 2):
    """Starts a query that adds the files arriving in ``folder`` to a manifest store.

    Files hold raw records with ``source`` and ``seq``, their order within a batch.
    A batch that runs again replaces its own part of the store.
    """

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.read.parquet(store).where(F.col("batch") < number) if exists(session, store) else None
        rows = records.normalize(batch, keep=("seq",))
        if old is not None:
            rows = rows.join(old.select("id").distinct(), "id", "left_anti")
        rows = records.keep_first(rows, "id", ["seq"])
        start = old.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1 if old is not None else 0
        rows = records.dense_order(rows, "seq", "id", into="ord").drop("seq").withColumn("ord", F.col("ord") + start)
        kept = spatial.deduplicate(rows, radius_m, max_per_cluster) if old is None else decide(old.drop("batch"), rows, radius_m, max_per_cluster)
        kept.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
