from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoloom.cli import parser
from geoloom.operators import preview, retrieval
from geoloom.session import healthy


def test_sample(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("id"))
    a = [r.id for r in preview.sample(rows, 20).orderBy("idx").collect()]
    assert len(set(a)) == 20 and a == [r.id for r in preview.sample(rows, 20).orderBy("idx").collect()]
    assert preview.sample(rows, 100).count() == 30
    with pytest.raises(ValueError):
        preview.sample(rows, 0)


def test_bad_places_leave_their_slot_blank(spark):
    rows = spark.createDataFrame([(k, "x" if k == 2 else " 55.5", "nan" if k == 3 else "37.5") for k in range(5)], "idx int, lat string, lon string")
    assert [(r.idx, r.slot_row, r.slot_col) for r in preview.layout(rows).orderBy("idx").collect()] == [(0, 0, 0), (1, 0, 1), (4, 1, 0)]
    assert preview.collage_size(5) == (1280, 360)


def test_retrieval(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, [-1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = retrieval.top_k(v.where("vec_id = 0"), v, 3)
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [1, 2, 4]
    places = v.select("vec_id", F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"))
    row = retrieval.locate(found, places).first()
    assert row.lat == pytest.approx(55.0) and 0 < row.confidence <= 1 and "3 similar" in row.explanation


def test_health(spark):
    assert healthy(spark) == (200, {"status": "ok"})


def test_command_defaults():
    a = parser().parse_args(["merge", "--nested", "a", "--flat", "b", "--out", "c"])
    assert (a.dedup_radius_m, a.max_per_cluster) == (7.0, 2)
    a = parser().parse_args(["ingest-flat", "--store", "s"])
    assert (a.limit_per_tile, a.request_retries, a.max_pages_per_tile) == (1000, 5, 200)


def test_many_queries_run_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(40)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, retrieval.top_k(v, v, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 9)
    assert sorted(map(tuple, retrieval.top_k(v, v, 3).collect())) == whole and len(whole) == 120
