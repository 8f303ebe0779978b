"""Validation of a manifest: coordinates, required columns and image files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ISSUES, REQUIRED
from ..tables import Scratch, writing
from .grid import AREA


def valid_coord(lat: Column, lon: Column) -> Column:
    """Inside the area, edges included; null and NaN aren't."""
    return F.coalesce(lat.between(AREA["min_lat"], AREA["max_lat"]) & lon.between(AREA["min_lon"], AREA["max_lon"]), F.lit(False))


def missing_columns(manifest: DataFrame) -> list[str]:
    """One entry for each required column that the schema lacks; values don't matter."""
    return [f"missing_column:{c}" for c in REQUIRED if c not in manifest.columns]


def local_path(path: Column) -> Column:
    """A path without its file scheme, however many slashes that has."""
    return F.regexp_replace(path, "^file:/+", "/")


def flags(manifest: DataFrame, images: DataFrame | None = None, min_bytes: int = 10_000, order: str | None = None) -> DataFrame:
    """row_id, ord and one boolean for each kind of issue of a row.

    ``images`` has path, length and broken, as :func:`geoloom.sources.images.scan`
    gives them; without it images aren't judged.  A missing image is neither too
    small nor broken; a present one can be both, and a bad place has no bearing.
    """
    def column(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in manifest.columns else F.lit(None).cast(kind)

    rows = manifest.select(
        F.coalesce(column("id", "string"), F.lit("None")).alias("row_id"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("ord"),
        (~valid_coord(column("lat", "double"), column("lon", "double"))).alias("invalid_coords"),
        local_path(column("image_path", "string")).alias("_path"),
    )
    if images is None:
        return rows.drop("_path").select("row_id", "ord", "invalid_coords", *(F.lit(False).alias(x) for x in ISSUES[2:]))
    files = images.select(local_path(F.col("path")).alias("_file"), "length", "broken")
    joined = rows.join(files, rows["_path"] == files["_file"], "left")
    there = F.col("_file").isNotNull()
    return joined.select("row_id", "ord", "invalid_coords", (~there).alias("missing_images"), F.coalesce(there & (F.col("length") < min_bytes), F.lit(False)).alias("too_small"), F.coalesce(there & F.col("broken"), F.lit(False)).alias("broken_images"))


def summary(found: DataFrame, n_missing_columns: int = 0) -> DataFrame:
    """One row: rows, and the number of each kind of issue."""
    counts = [F.count_if(F.col(x)).alias(x) for x in ISSUES[1:]]
    return found.agg(F.count("*").alias("rows"), F.lit(n_missing_columns).cast("long").alias(ISSUES[0]), *counts)


def issues(found: DataFrame) -> DataFrame:
    """category, row_id, ord: a row for each issue; a manifest row may have several."""
    kinds = F.array_compact(F.array(*(F.when(F.col(x), F.lit(x)) for x in ISSUES[1:])))
    return found.select(F.explode(kinds).alias("category"), "row_id", "ord")


def write_report(path: str, manifest: DataFrame, images: DataFrame | None = None, min_bytes: int = 10_000, order: str | None = None) -> dict:
    """Writes the summary, and the ids of every issue by kind in row order, as one JSON file; returns the summary.

    Lists are whole.  They are streamed from Spark into the file, partition by
    partition, so the driver holds a part of one at a time.
    """
    columns = missing_columns(manifest)
    with Scratch(manifest.sparkSession, "validate") as keep:
        found = keep(flags(manifest, images, min_bytes, order), "flags")
        counts = summary(found, len(columns)).first().asDict()
        with writing(manifest.sparkSession, path) as out:
            out(('{\n  "summary": ' + json.dumps(counts) + ',\n  "issues": {').encode())
            for n, kind in enumerate(ISSUES):
                listed = columns if not n else (r.row_id for r in found.where(kind).orderBy("ord").select("row_id").toLocalIterator())
                out((("," if n else "") + f'\n    "{kind}": [').encode())
                for k, entry in enumerate(listed):
                    out(((", " if k else "") + json.dumps(entry, ensure_ascii=False)).encode())
                out(b"]")
            out(b"\n  }\n}\n")
    return counts
