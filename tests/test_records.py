from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from geoloom.operators import parse, records
from geoloom.plans import jobs
from geoloom.schemas import MANIFEST


def items(spark, *values):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "ord long, json string")


def nested(**more):
    return {"id": "1", "geometry": {"coordinates": [37.61, 55.75]}} | more


def test_nested_item(spark):
    row = parse.parse_nested(items(spark, nested(id=8810, sequence={"id": "run-9"}, captured_at="t", thumb_1024_url="u"))).first()
    assert (row.id, row.lat, row.lon, row.sequence_id, row.timestamp, row.image_url) == ("8810", 55.75, 37.61, "run-9", "t", "u")


@pytest.mark.parametrize(
    ("change", "kept"),
    [
        ({"geometry": {}, "computed_geometry": {"coordinates": [1, 2]}}, True),
        ({"geometry": {"type": "Point"}, "computed_geometry": {"coordinates": [1, 2]}}, False),
        ({"geometry": {"coordinates": [None, 55.7]}}, True),
        ({"geometry": {"coordinates": [1]}}, False),
        ({"geometry": [1, 2]}, False),
        ({"id": None}, False),
        ({"geometry": None, "computed_geometry": None}, False),
    ],
)
def test_geometry_fallback(spark, change, kept):
    assert parse.parse_nested(items(spark, nested(**change))).count() == kept


@pytest.mark.parametrize(("value", "want"), [("s", "s"), (7, "7"), ({}, None), ({"id": 0}, None), ({"id": "0"}, "0"), (None, None), ("", None)])
def test_sequences(spark, value, want):
    assert parse.parse_nested(items(spark, nested(sequence=value))).first().sequence_id == want


def test_flat_items(spark):
    rows = parse.parse_flat(items(spark, {"photoId": "b-77", "latitude": "48.3", "longitude": 16.4}, {"id": 0, "photoId": 5, "lat": 0.0, "lon": 0.0}, {"id": 1, "lat": None, "lon": 1}, 5, [1])).orderBy("ord").collect()
    assert [(r.id, r.lat, r.lon) for r in rows] == [("b-77", 48.3, 16.4), ("0", 0.0, 0.0)]


def test_bad_places(spark):
    some = items(spark, *({"id": k, "lat": "abc" if k == 2 else 1, "lon": 1} for k in range(5))).withColumn("tile", F.lit(0))
    assert parse.parse_flat(some).count() == 4 and parse.rejected_flat(some).count() == 1
    assert [r.id for r in parse.parse_flat_failing_tiles(some, "tile", "ord").orderBy("ord").collect()] == ["0", "1"]


def raw(spark, *rows):
    full = [{"ord": k, "id": "a5", "lat": 55.75, "lon": 37.61, "image_url": "https://img.test/p5", "url": None, "license": None, "source": "mapillary"} | r for k, r in enumerate(rows)]
    kinds = "ord long, id string, lat double, lon double, image_url string, url string, license string, source string"
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in kinds.split(", ")) for r in full], kinds)


def test_manifest_columns(spark):
    row = records.normalize(raw(spark, {}))
    assert row.columns == [f.name for f in MANIFEST.fields] and [f.dataType for f in row.schema] == [f.dataType for f in MANIFEST.fields]
    one = row.first()
    assert one.download_url == "https://img.test/p5" and one.image_path.startswith("data/raw/images/mapillary/") and (one.license, one.attribution) == ("CC-BY-SA", "Mapillary")


def test_ids_depend_on_the_source(spark):
    ids = [r.id for r in records.normalize(raw(spark, {}, {}, {"source": "KartaView"}), keep=("ord",)).orderBy("ord").collect()]
    assert ids[0] == ids[1] == "06ca0463-356c-5a73-99ce-59bf122c6dd8" and ids[2] == "2bc69f59-a74d-5454-9e2f-ced62c5add35"


@pytest.mark.parametrize(("change", "url"), [({"image_url": ""}, None), ({"image_url": "", "url": ""}, ""), ({"image_url": "", "url": "u"}, "u"), ({"lat": None}, None), ({"id": None}, None), ({"lat": 0.0}, "https://img.test/p5")])
def test_dropped_records(spark, change, url):
    assert [r.download_url for r in records.normalize(raw(spark, change)).collect()] == ([] if url is None else [url])


def test_defaults(spark):
    row = records.normalize(raw(spark, {"license": "", "source": "OTHER"})).first()
    assert (row.source, row.attribution, row.license) == ("other", "KartaView", "CC-BY-SA")


def test_keep_first_and_resume(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), (None, 0, "n")], "id string, n int, v string")
    assert sorted(map(tuple, records.keep_first(rows, "id", ["n"]).collect())) == [("a", 1, "y"), ("b", 3, "z")]
    old = spark.createDataFrame([("a", 9, "o")], "id string, n int, v string")
    assert sorted(map(tuple, records.append(old, rows, "id", ["n"]).collect())) == [("a", 9, "o", False), ("b", 3, "z", True)]


def test_dense_order(spark):
    rows = records.dense_order(spark.range(50).select((F.col("id") * 37 % 50).alias("k")), "k", into="n").collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 50


def test_manifest_of_two_sources(spark):
    a = raw(spark, {}).drop("source")
    b = raw(spark, {"id": "b5", "lat": 55.750001}, {"id": "b6", "lat": 55.750002}).drop("source")
    kept = jobs.build_manifest(spark, a, b).orderBy("ord").collect()
    assert [(r.source, r.source_image_id) for r in kept] == [("mapillary", "a5"), ("kartaview", "b5")]
