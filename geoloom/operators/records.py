"""Keep-first, resuming, uniting and normalising records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import default_if_falsy, safe_filename, uuid5
from ..schemas import MANIFEST
from ..tables import written

IMAGE_ROOT = "data/raw/images"


def keep_first(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given total order; null keys never match.

    The least struct of each key is found by partial aggregation, so that a key
    which holds many rows leaves each task as one.
    """
    others = [x for x in rows.columns if x not in order]
    ordered = F.struct(*(F.col(x) for x in (*order, *others)))
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(ordered, F.struct(*order)).alias("_row"))
    return first.select("_row.*").select(*rows.columns)


def resume(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``new`` rows of keys that ``existing`` lacks, first of each key."""
    return keep_first(new.join(existing.select(key).distinct(), key, "left_anti").select(*new.columns), key, order)


def append(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``existing``, then what :func:`resume` lets in, with ``is_new``."""
    fresh = resume(existing, new, key, order).withColumn("is_new", F.lit(True))
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh, allowMissingColumns=True)


def unite(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Records of the sources in this order: ``source``, and ``rank`` before ``ord``."""
    every = None
    for rank, (name, rows) in enumerate(sources):
        one = rows.withColumn("source", F.lit(name)).withColumn("rank", F.lit(rank))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every


def dense_order(rows: DataFrame, *order: str, into: str = "ord") -> DataFrame:
    """Numbers rows from 0 in a total order, without one task that sorts them all.

    Range partitions are numbered one after the other: the count of each, of which
    there are as many as partitions, is summed up, and rows are numbered within.
    The ranges are a table in the shared folder, since a second sort could cut them elsewhere.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(bases), "_part").withColumn(into, F.col("_base") + number - 1).drop("_part", "_base")


def record_id(source: Column, source_image_id: Column) -> Column:
    return uuid5(F.concat_ws(":", source, source_image_id))


def download_url(image_url: Column, url: Column) -> Column:
    """The image's url if it is true, else the plain one, which may be empty."""
    return F.coalesce(F.nullif(image_url, F.lit("")), url)


#: What a raw record may lack altogether; lacking means null.
OPTIONAL = {"timestamp": "string", "heading": "double", "image_url": "string", "url": "string", "thumb_path": "string", "license": "string", "attribution": "string", "raw_json": "string"}


def normalize(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw records with ``source`` to the manifest's columns; ``keep`` stays beside them.

    Rows without a place, an id or any url are dropped; 0.0 and an empty plain url
    are kept.  A place that is no number is an error.  ``raw_json`` is kept as the
    metadata; where it is missing, the raw fields make it up.
    """
    raw = rows
    for name, kind in OPTIONAL.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    source = F.lower("source")
    own = F.col("id").cast("string")
    key = record_id(source, own)
    url = download_url(F.col("image_url"), F.col("url"))
    fields = [x for x in raw.columns if x not in ("source", "rank", "ord", "raw_json", *keep)]
    columns = {
        "id": key,
        "source": source,
        "source_image_id": own,
        "lat": F.col("lat").cast("double"),
        "lon": F.col("lon").cast("double"),
        "captured_at": F.col("timestamp").cast("string"),
        "heading": F.col("heading").cast("double"),
        "image_path": F.concat(F.lit(f"{IMAGE_ROOT}/"), source, F.lit("/"), key, F.lit("_"), safe_filename(own), F.lit(".jpg")),
        "thumb_path": F.col("thumb_path").cast("string"),
        "license": default_if_falsy("license", "CC-BY-SA"),
        "attribution": default_if_falsy("attribution", F.when(source == "mapillary", F.lit("Mapillary")).otherwise(F.lit("KartaView"))),
        "metadata_json": F.coalesce("raw_json", F.to_json(F.struct(*(F.col(x) for x in fields)))),
        "download_url": url,
    }
    usable = raw.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("id").isNotNull() & url.isNotNull())
    return usable.select(*keep, *(columns[f.name].cast(f.dataType).alias(f.name) for f in MANIFEST.fields))
