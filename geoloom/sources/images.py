"""Image files: sizes, and whether they can be decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import exists


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, broken of all files below a folder; none where it is missing.

    Sizes come from a listing that reads no content.  An image is broken if it
    can't be decoded in whole, which is stricter than a look at its structure.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, length long, broken boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    decoded = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    decoded = decoded.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("origin"), (F.col("image.height") < 0).alias("broken"))
    joined = files.join(decoded, F.regexp_replace(files["path"], "^file:/+", "/") == decoded["origin"], "left")
    return joined.select("path", "length", F.coalesce("broken", F.lit(True)).alias("broken"))


def quality(spark: SparkSession, folder: str, least_side: int = 320, most_ratio: float = 3.0) -> DataFrame:
    """path, width, height, channels, problem of uploaded images; null where nothing is wrong.

    broken: can't be decoded; small: a side under ``least_side``; narrow: one side
    more than ``most_ratio`` times the other; flat: fewer than three channels.
    """
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    w, h, n = (F.col(f"image.{x}") for x in ("width", "height", "nChannels"))
    problem = F.when(h < 0, "broken").when(F.least(w, h) < least_side, "small").when(F.greatest(w, h) > most_ratio * F.least(w, h), "narrow").when(n < 3, "flat")
    seen = lambda x: F.when(h >= 0, x)
    return found.select(F.col("image.origin").alias("path"), seen(w).alias("width"), seen(h).alias("height"), seen(n).alias("channels"), problem.alias("problem"))
