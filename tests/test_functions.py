from __future__ import annotations

import math
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import scalar
from geoloom.operators import grid


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_record_ids_match_the_known_ones(spark):
    known = {"mapillary:a5": "06ca0463-356c-5a73-99ce-59bf122c6dd8", "kartaview:a5": "2bc69f59-a74d-5454-9e2f-ced62c5add35", "kartaview:é-9": "35694a05-3c12-5beb-adf7-d9d877bc16d4"}
    rows = spark.createDataFrame([(k,) for k in known], "k string").select("k", scalar.uuid5("k").alias("id")).collect()
    assert {r.k: r.id for r in rows} == known


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=20, max_size=20))
def test_record_ids_are_version_5(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scalar.uuid5("k").alias("id")).collect()
    assert all(r.id == str(uuid.uuid5(scalar.RECORD_NAMESPACE, r.k)) for r in rows)


@pytest.mark.parametrize(("name", "safe"), [("...", "unknown"), ("._a._", "a"), ("é/é", "unknown"), ("../x\\y", "x_y"), ("", "unknown"), ("ok-1.jpg", "ok-1.jpg")])
def test_safe_filename(spark, name, safe):
    assert one(spark, scalar.safe_filename(F.lit(name))) == safe


def test_distances(spark):
    d = one(spark, scalar.haversine_m(F.lit(55.75), F.lit(37.61), F.lit(55.75001), F.lit(37.61001)))
    assert d == pytest.approx(1.275958, abs=1e-5)


def test_cells_truncate_toward_zero(spark):
    assert one(spark, F.array(*scalar.cell(F.lit(55.75), F.lit(37.61), 7.0))) == [886584, 349235]
    assert one(spark, scalar.cell(F.lit(-0.00001), F.lit(0.0), 7.0)[0]) == 0
    with pytest.raises(Exception, match="CAST|overflow"):
        one(spark, scalar.cell(F.lit(math.nan), F.lit(0.0), 7.0)[0])


def test_fallbacks_by_presence_and_by_truth(spark):
    assert one(spark, scalar.first_present(F.lit(None).cast("int"), F.lit(0), F.lit(5))) == 0
    assert one(spark, scalar.first_truthy(F.lit(""), F.lit(None), F.lit("b"), F.lit(""))) == "b"
    assert one(spark, scalar.first_truthy(F.lit(""), F.lit(None).cast("string"), F.lit(""))) == ""


def test_sql_functions(spark):
    scalar.register_sql(spark)
    row = spark.sql("SELECT safe_filename('._a/b._') AS n, safe_filename('..') AS u, haversine_m(0D, 0D, 0D, 1D) AS d").first()
    assert (row.n, row.u) == ("a_b", "unknown") and row.d == pytest.approx(111194.9266, abs=0.01)


def test_grid_of_four(spark):
    rows = grid.build_grid(spark, min_lat=55.55, max_lat=55.57, min_lon=37.30, max_lon=37.32).orderBy("tile_no").collect()
    assert len(rows) == 4 and (rows[0].min_lat, rows[0].max_lat) == (55.55, 55.55 + 0.01)


def test_default_grid(spark):
    rows = grid.default_tiles(spark).orderBy("tile_no").collect()
    assert len(rows) == 2400 and (rows[0].min_lat, rows[0].min_lon) == (55.55, 37.30)
    assert (rows[-1].max_lat, rows[-1].max_lon) == (55.94999999999992, 37.89999999999988)


def test_last_tile_is_clamped(spark):
    assert grid.build_grid(spark, min_lat=0.0, max_lat=1.0, min_lon=0.0, max_lon=0.03, lat_step=0.3, lon_step=0.03).agg(F.max("max_lat")).first()[0] == 1.0


@pytest.mark.parametrize("steps", [(0.2, 0.2), (0.1, 0.1), (0.05, 0.2), (0.0, 0.01), (0.01, -1)])
def test_grid_guards(spark, steps):
    with pytest.raises(ValueError):
        grid.build_grid(spark, min_lat=0, max_lat=1, min_lon=0, max_lon=1, lat_step=steps[0], lon_step=steps[1])


def test_box_text():
    box = grid.BBox(1.0, 2.0, 3.0, 4.0)
    assert box.query_text() == "3.0,1.0,4.0,2.0" and box._asdict()["max_lon"] == 4.0
