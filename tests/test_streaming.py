from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from geoloom.functions.scalar import haversine_m
from geoloom.operators import spatial
from geoloom.streaming.incremental import decide, stream_manifest

SCHEMA = "id string, lat double, lon double, image_url string, source string, seq long"


def photos(rng, n, first):
    return [{"id": f"p{first + k}", "lat": 55.75 + rng.randrange(40) * 1e-5, "lon": 37.61 + rng.randrange(40) * 1e-5, "image_url": "u", "source": "mapillary", "seq": k} for k in range(n)]


def test_arrivals_are_decided_as_one_run_would(spark):
    rng = random.Random(3)
    points = [(k, 55.75 + rng.randrange(30) * 1e-5, 37.61 + rng.randrange(30) * 1e-5) for k in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "ord long, lat double, lon double")
    whole = {r.ord for r in spatial.deduplicate(frame(points)).collect()}
    first = spatial.deduplicate(frame(points[:180]))
    second = decide(first, frame(points[180:]))
    assert {r.ord for r in first.collect()} | {r.ord for r in second.collect()} == whole


def test_a_stream_of_files_grows_the_manifest(spark, tmp_path):
    rng = random.Random(5)
    arrivals, store = tmp_path / "in", str(tmp_path / "store")
    arrivals.mkdir()
    one, two = photos(rng, 80, 0), photos(rng, 80, 60)  # 20 ids come again
    for name, items in (("a", one), ("b", two)):
        (arrivals / f"{name}.json").write_text("\n".join(json.dumps(x) for x in items))
        stream_manifest(spark, str(arrivals), SCHEMA, store, str(tmp_path / "checkpoint")).awaitTermination()
    found = spark.read.parquet(store)
    assert found.select("batch").distinct().count() == 2 and found.count() == found.select("id").distinct().count() == found.select("ord").distinct().count()
    near = found.alias("a").join(found.alias("b"), F.expr("a.ord > b.ord")).where(haversine_m("a.lat", "a.lon", "b.lat", "b.lon") <= 6.5)
    assert near.groupBy("a.ord").count().agg(F.max("count")).first()[0] == 1  # no more than two together
    kept = found.count()
    stream_manifest(spark, str(arrivals), SCHEMA, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(store).count() == kept
