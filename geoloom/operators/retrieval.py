"""Similarity retrieval over embeddings.  Extensions: only promised, not defined, elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from ..tables import written
from .nearest import nearest


def dot(a: Column, b: Column) -> Column:
    """Skips what is null or beyond the shorter vector; null if nothing is left."""
    products = F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(products) > 0, F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


#: Queries up to this many are compared at once: some hundred bytes each.
BROADCAST_QUERIES = 10_000
#: Vectors of a task: the fewest for which another one is made while cores are free, and the most.
FEWEST, MOST = 4096, 65_536


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest by dot product, itself left out.

    ``queries`` is a stated set and meets all vectors; ties go to the lesser id.
    More than ``BROADCAST_QUERIES`` are dealt by a hash of their ids into blocks of
    about that many; each is broadcast in turn and its result joins the others'.
    Each task of vectors keeps its own best k (:mod:`nearest`), so that what is
    shuffled grows with queries and tasks, not with pairs.  Ids that aren't whole
    numbers take the pairs.
    """
    kind = queries.schema["vec_id"].dataType
    whole = isinstance(kind, IntegralType) and vectors.schema["vec_id"].dataType == kind
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // MOST), min(-(-n // FEWEST), 2 * cores))
    near = (lambda asked: _nearest(asked, vectors, k, tasks)) if whole else (lambda asked: _pairs(asked, vectors))
    n_blocks = -(-queries.count() // BROADCAST_QUERIES)
    if n_blocks > 1:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
        return reduce(DataFrame.unionByName, [written(_ranked(near(queries.where(block == b)), k), "nearest") for b in range(n_blocks)])
    return _ranked(near(queries), k)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    asked = F.broadcast(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")))
    return vectors.join(asked, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", dot(F.col("_q"), F.col("embedding")).alias("similarity"))


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, tasks: int) -> DataFrame:
    def plain(rows: DataFrame) -> DataFrame:
        item = rows.schema["embedding"].dataType.elementType
        numbers = F.col("embedding") if isinstance(item, (FloatType, DoubleType)) else F.col("embedding").cast("array<double>")
        return rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))

    asked, kind = queries.sparkSession.sparkContext.broadcast(plain(queries).toArrow()), queries.schema["vec_id"].dataType
    found = plain(vectors).repartition(tasks, "vec_id").mapInArrow(nearest(lambda: asked.value, k), "query_id long, vec_id long, similarity double")
    return found.select(F.col("query_id").cast(kind).alias("query_id"), F.col("vec_id").cast(kind).alias("vec_id"), "similarity")


def locate(found: DataFrame, places: DataFrame) -> DataFrame:
    """query_id, lat, lon, confidence, explanation from the candidates' places.

    The place is the mean weighted by similarities, none below 0; the confidence is
    the share of the best candidate in the softmax of ten times the similarities.
    """
    weight, soft = F.greatest(F.col("similarity"), F.lit(0.0)), F.exp(10 * F.col("similarity"))
    total = F.sum(weight)
    sums = found.join(places, "vec_id").groupBy("query_id").agg(
        F.when(total > 0, F.sum(weight * F.col("lat")) / total).otherwise(F.avg("lat")).alias("lat"),
        F.when(total > 0, F.sum(weight * F.col("lon")) / total).otherwise(F.avg("lon")).alias("lon"),
        (F.max(soft) / F.sum(soft)).alias("confidence"),
        F.size(F.collect_set("rank")).alias("n"),  # candidates, also where an id has several places
    )
    return sums.select("query_id", "lat", "lon", "confidence", F.format_string("estimated from %d similar images with confidence %.2f", "n", F.coalesce("confidence", F.lit(float("nan")))).alias("explanation"))
