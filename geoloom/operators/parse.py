"""Raw items of both providers to parsed records, by paths into VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import Value, first_present, first_truthy, with_values

NESTED_PATHS = {
    "id": "id", "geometry": "geometry", "computed": "computed_geometry", "time": "captured_at", "sequence": "sequence", "sequence_id": "sequence.id",
    "u1": "thumb_2048_url", "u2": "thumb_1024_url", "u3": "thumb_original_url", "u4": "url",
}
#: Provider B's names of each field, in the order in which they are tried.
FLAT_NAMES = {
    "id": ("id", "photoId", "imageId"), "lat": ("lat", "latitude", "gpsLat"), "lon": ("lon", "lng", "longitude", "gpsLng"),
    "time": ("shotDate", "dateAdded", "timestamp"), "url": ("fileurlProc", "fileurl", "thumbnailUrl", "url"),
}


def nested_columns(v: dict[str, Value]) -> dict[str, Column]:
    """Provider A: geometry with [lon, lat], a chain of thumbnails, a sequence."""
    def pair(x: Value) -> Column:
        return F.when(x.kind == "OBJECT", F.try_variant_get(x.value, "$.coordinates", "array<variant>"))

    # Only a false geometry gives way to the computed one; a true one that is unusable drops the row.
    chosen = F.when(v["geometry"].truthy(), pair(v["geometry"])).otherwise(pair(v["computed"]))
    inner = v["sequence_id"]
    return {
        "id": v["id"].text(),
        "_pair": chosen,
        "timestamp": v["time"].text(),
        "image_url": first_truthy(v["u1"], v["u2"], v["u3"], v["u4"]),
        "sequence_id": F.when(v["sequence"].kind == "OBJECT", F.when(inner.truthy(), inner.text())).otherwise(F.when(v["sequence"].truthy(), v["sequence"].text())),
    }


def flat_columns(v: dict[str, Value]) -> dict[str, Column]:
    """Provider B: every field under several names; ids and places by presence, the rest by truth."""
    def all_of(field: str) -> tuple[Value, ...]:
        return tuple(v[x] for x in FLAT_NAMES[field])

    def any_present(field: str) -> Column:
        return F.greatest(*(x.present() for x in all_of(field)))

    return {
        "id": first_present(all_of("id"), Value.text).cast("string"),
        "lat": first_present(all_of("lat"), Value.number).cast("double"),
        "lon": first_present(all_of("lon"), Value.number).cast("double"),
        "timestamp": first_truthy(*all_of("time")),
        "image_url": first_truthy(*all_of("url")),
        "sequence_id": F.lit(None).cast("string"),
        "_usable": any_present("lat") & any_present("lon"),
    }


def _parsed(items: DataFrame, json: str, paths: dict[str, str], columns) -> DataFrame:
    others = [x for x in items.columns if x != json]
    rows, values = with_values(items, json, paths)
    # A generator, so that later filters don't copy these expressions below the projections.
    return rows.select(*others, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns(values).items())))))


def _nested(items: DataFrame, json: str) -> DataFrame:
    found = _parsed(items, json, NESTED_PATHS, nested_columns).where("size(_pair) >= 2 and id is not null")
    places = {n: F.try_variant_get(F.get("_pair", F.lit(k)), "$", "double") for n, k in (("lat", 1), ("lon", 0))}
    others = [x for x in items.columns if x != json]
    return found.withColumns(places).select(*others, "id", "lat", "lon", "timestamp", "image_url", "sequence_id")


def _flat(items: DataFrame, json: str) -> DataFrame:
    return _parsed(items, json, {x: x for names in FLAT_NAMES.values() for x in names}, flat_columns).where("_usable and id is not null").drop("_usable")


def parse_nested(items: DataFrame, json: str = "json") -> DataFrame:
    """Usable records of provider A.  [null, 55.7] is usable here; normalising drops it."""
    return _nested(items, json)


def parse_flat(items: DataFrame, json: str = "json") -> DataFrame:
    """Usable records of provider B.

    A place that is no number drops its own row alone, and :func:`rejected_flat`
    reports it.  A loader that stops at it would lose the rest of the tile.
    """
    return _flat(items, json).where("lat is not null and lon is not null")


def rejected_flat(items: DataFrame, json: str = "json") -> DataFrame:
    """Items of provider B with a place that is present but no number."""
    return _flat(items, json).where("lat is null or lon is null")


def parse_flat_failing_tiles(items: DataFrame, tile: str, order: str, json: str = "json") -> DataFrame:
    """As :func:`parse_flat`, but what follows a bad place in its tile is lost, too."""
    first = rejected_flat(items, json).groupBy(tile).agg(F.min(order).alias("_bad"))
    return parse_flat(items, json).join(first, tile, "left").where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")
