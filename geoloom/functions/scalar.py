"""Column builders: ids, names, distances, cells and fallbacks.  All stay in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of record ids.
RECORD_NAMESPACE = uuid.UUID("58e0f6ca-e665-4fb6-8427-8e9205467f52")
EARTH_RADIUS_M = 6_371_000.0
#: Metres per degree that size the cells: of latitude, and of longitude.
LAT_METRES, LON_METRES = 111_320.0, 65_000.0

Name = Column | str


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uuid5(key: Name, namespace: uuid.UUID = RECORD_NAMESPACE) -> Column:
    """The name-based UUID, version 5, of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(_col(key), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def safe_filename(value: Name) -> Column:
    """Letters, digits, dot, underscore and hyphen; other runs become one underscore."""
    tidy = F.btrim(F.regexp_replace(_col(value), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.when(tidy == "", F.lit("unknown")).otherwise(tidy)


def haversine_m(lat1: Name, lon1: Name, lat2: Name, lon2: Name) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp, dl = F.radians(_col(lat2) - _col(lat1)), F.radians(_col(lon2) - _col(lon1))
    chord = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * F.lit(EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def cell(lat: Name, lon: Name, radius_m: float) -> tuple[Column, Column]:
    """Grid cell of a point; truncated toward zero, and an error where it isn't finite."""
    return ((_col(lat) / (radius_m / LAT_METRES)).cast("bigint"), (_col(lon) / (radius_m / LON_METRES)).cast("bigint"))


def first_present(*cols: Name) -> Column:
    """The first that isn't null; 0 and '' count."""
    return F.coalesce(*(_col(c) for c in cols))


def first_truthy(*cols: Name) -> Column:
    """The first text that is neither null nor empty; the last one whatever it is."""
    *early, last = (_col(c) for c in cols)
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in early), last)


def default_if_falsy(value: Name, default: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def bbox_text(min_lat: Name, max_lat: Name, min_lon: Name, max_lon: Name) -> Column:
    """What providers take: min_lon,min_lat,max_lon,max_lat."""
    return F.concat_ws(",", *(_col(c).cast("string") for c in (min_lon, min_lat, max_lon, max_lat)))


def backoffs(retries: Name, backoff_sec: float) -> Column:
    """The pauses before each further attempt: they grow by ``backoff_sec``."""
    n = _col(retries).cast("int")
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: k * F.lit(float(backoff_sec))))


def url_missing(url: Name) -> Column:
    return _col(url).isNull() | (_col(url) == "") | (F.lower(_col(url)) == "nan")


def retryable(status: Name) -> Column:
    """Statuses after which a request is worth another attempt."""
    return _col(status).isin(429, 500, 502, 503, 504)


def register_sql(spark) -> None:
    """The same functions for SQL texts, as temporary SQL functions."""
    radius = EARTH_RADIUS_M
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
        f"2 * {radius}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_filename(v STRING) RETURNS STRING RETURN coalesce(nullif(trim(BOTH '._' FROM regexp_replace(v, '[^A-Za-z0-9._-]+', '_')), ''), if(v IS NULL, NULL, 'unknown'))")
