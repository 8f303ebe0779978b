from __future__ import annotations

import math
import random
import time

import pytest

from geoloom.operators import spatial
from geoloom.streaming.incremental import decide


def loop(points, radius=7.0, cap=2, reach=1):
    """The order-respecting loop, point by point."""
    kept = []

    def cell(p):
        return int(p[1] / (radius / 111_320.0)), int(p[2] / (radius / 65_000.0))

    def distance(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(a))

    for p in sorted(points):
        near = sum(all(abs(a - b) <= reach for a, b in zip(cell(p), cell(q), strict=True)) and distance(p, q) <= radius for q in kept)
        if near < cap:
            kept.append(p)
    return [p[0] for p in kept]


def frame(spark, points):
    return spark.createDataFrame(points, "ord long, lat double, lon double")


def kept(df):
    return sorted(r.ord for r in df.collect())


@pytest.mark.parametrize(("seed", "cap", "spread"), [(1, 2, 40), (2, 1, 30), (3, 3, 15), (4, 2, 5)])
def test_equals_the_loop(spark, seed, cap, spread):
    rng = random.Random(seed)
    points = [(k, 55.75 + rng.randrange(spread) * 1e-5, 37.61 + rng.randrange(spread) * 1e-5) for k in range(250)]
    assert kept(spatial.deduplicate(frame(spark, points), max_per_cluster=cap)) == loop(points, cap=cap)


def test_chains_across_blocks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK_CELLS", 4)
    monkeypatch.setattr(spatial, "MOST_POINTS", 60)
    rng = random.Random(9)
    step = 3 / 111_194.9
    drive = [(55.75 + k * step, 37.61 + (k % 3) * 1e-6) for k in range(300)]
    parked = [(55.752, 37.61)] * 150 + [(55.7521, 37.6101)] * 80
    field = [(55.753 + rng.random() * 4e-4, 37.62 + rng.random() * 4e-4) for _ in range(400)]
    places = drive + parked + field
    rng.shuffle(places)
    points = [(k, *x) for k, x in enumerate(drive + places)]
    assert kept(spatial.deduplicate(frame(spark, points))) == loop(points)


def test_drives_and_parked_cameras_take_no_more_time_than_others(spark):
    step = 3 / 111_194.9
    drive = [(k, 55.0 + k * step, 37.61) for k in range(10_000)]
    parked = [(k, 55.75, 37.61) for k in range(10_000, 20_000)]
    began = time.monotonic()
    found = kept(spatial.deduplicate(frame(spark, drive + parked)))
    assert time.monotonic() - began < 60 and len([x for x in found if x >= 10_000]) == 2
    assert [x for x in found if x < 500] == loop(drive[:500])


def test_four_points(spark):
    points = [(1, 55.8, 37.5), (2, 55.80002, 37.50002), (3, 55.80003, 37.50001), (4, 55.81, 37.5)]
    assert kept(spatial.deduplicate(frame(spark, points))) == [1, 2, 4]


def test_rejected_points_block_nobody(spark):
    step = 5 / 111_194.9
    assert kept(spatial.deduplicate(frame(spark, [(k, 55.75 + k * step, 37.61) for k in range(3)]), max_per_cluster=1)) == [0, 2]


def test_cells_hide_close_points_unless_asked(spark):
    c = 7 / 65_000
    points = [(0, 55.75, (349235 + 0.99) * c), (1, 55.75, (349235 + 2.02) * c)]
    assert kept(spatial.deduplicate(frame(spark, points), max_per_cluster=1)) == [0, 1]
    assert kept(spatial.deduplicate(frame(spark, points), max_per_cluster=1, exact_radius=True)) == [0]


def test_guards(spark):
    points = frame(spark, [(0, 55.75, 37.61)] * 1)
    assert kept(spatial.deduplicate(points, radius_m=0)) == [0]
    for radius in (7, 0):
        with pytest.raises(ValueError):
            spatial.deduplicate(points, radius_m=radius, max_per_cluster=0)


def test_no_points(spark):
    assert spatial.deduplicate(frame(spark, [])).count() == 0


def test_batches_give_the_same_decisions(spark):
    rng = random.Random(9)
    points = [(k, 55.75 + rng.randrange(12) * 1e-5, 37.61 + rng.randrange(12) * 1e-5) for k in range(120)]
    first = spatial.deduplicate(frame(spark, points[:70]))
    second = decide(first, frame(spark, points[70:]))
    assert sorted(kept(first) + kept(second)) == loop(points)
