"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PARSED = _struct(("ord", L, False), ("id", S, True), ("lat", D, True), ("lon", D, True), ("timestamp", S, True), ("image_url", S, True), ("sequence_id", S, True))
RAW = _struct(("ord", L, False), ("id", S, True), ("lat", D, True), ("lon", D, True), ("timestamp", S, True), ("heading", D, True), ("image_url", S, True), ("url", S, True), ("thumb_path", S, True), ("license", S, True), ("attribution", S, True), ("raw_json", S, True))
MANIFEST = _struct(
    ("id", S, False), ("source", S, False), ("source_image_id", S, False), ("lat", D, False), ("lon", D, False), ("captured_at", S, True), ("heading", D, True),
    ("image_path", S, False), ("thumb_path", S, True), ("license", S, False), ("attribution", S, False), ("metadata_json", S, False), ("download_url", S, False),
)
#: Columns that validation asks for.
REQUIRED = ("id", "source", "source_image_id", "lat", "lon", "captured_at", "image_path")
ISSUES = ("missing_fields", "invalid_coords", "missing_images", "too_small", "broken_images")
