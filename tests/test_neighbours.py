"""Neighbour pairs, and counts of earlier neighbours, against a loop over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geoloom.operators import counting, spatial

LAT, LON = 7 / 111_320.0, 7 / 65_000.0


def cell(p):
    return int(p[1] / LAT), int(p[2] / LON)


def pairs(points, reach=1):
    """src and dst, with their distance, of all two points."""
    found, whole = [], [p for p in points if None not in p]
    for p in whole:
        for q in whole:
            if p[0] < q[0] and all(abs(a - b) <= reach for a, b in zip(cell(p), cell(q), strict=True)):
                a = math.sin(math.radians(p[1] - q[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(p[2] - q[2]) / 2) ** 2
                if (m := 2 * 6_371_000.0 * math.asin(math.sqrt(a))) <= 7:
                    found.append((p[0], q[0], m))
    return found


def wanted(points):
    n = Counter(dst for _, dst, _ in pairs(points))
    return sorted(((p, n[p[0]]) for p in points), key=repr)


def frame(spark, points, key="long"):
    return spark.createDataFrame(points, f"ord {key}, lat double, lon double")


def counted(found):
    return sorted((((r.ord, r.lat, r.lon), r.n_neighbours) for r in found.collect()), key=repr)


def joined(found):
    """The most rows that a join of a collected table made."""
    most, nodes = 0, [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(k) for k in range(node.children().size())]
    return most


def lattice(seed, n, spread, lat=55.75, lon=37.61):
    """Points with many copies."""
    rng = random.Random(seed)
    places = [(lat + rng.randrange(spread) * 1e-5, lon + rng.randrange(spread) * 1e-5) for _ in range(n)]
    return [(k, *place) for k, place in enumerate(places)]


def parked(n):
    return [(k, 55.75 + k % 3 * 1e-5, 37.61) for k in range(n)]


@pytest.mark.parametrize(("seed", "spread", "lat", "lon"), [(1, 40, 55.75, 37.61), (2, 8, 55.75, 37.61), (3, 30, -15e-5, -15e-5), (4, 400, -33.9, -70.6)])
def test_counts_equal_the_loop(spark, seed, spread, lat, lon):
    points = lattice(seed, 250, spread, lat, lon)
    assert counted(spatial.neighbour_counts(frame(spark, points))) == wanted(points)


def test_counts_of_odd_rows(spark):
    points = [(5, 55.75, 37.61), (5, 55.75, 37.61), (5, 55.75001, 37.61), (1, 55.75, 37.61), (-3, 55.75, 37.61), (2**62, 55.75, 37.61), (None, 55.75, 37.61), (7, None, 37.61), (8, 55.75, None)]
    assert counted(spatial.neighbour_counts(frame(spark, points))) == wanted(points)
    assert spatial.neighbour_counts(frame(spark, [])).count() == 0


def test_counts_in_the_order_of_texts(spark):
    points = [(f"{p[0] * 7 % 60:02}", *p[1:]) for p in lattice(5, 60, 8)]
    assert counted(spatial.neighbour_counts(frame(spark, points, "string"))) == wanted(points)


def test_counts_of_a_block_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COUNT_POINTS", 40)
    points = lattice(6, 300, 100) + [(k, 55.75, 37.61) for k in range(300, 400)]
    assert counted(spatial.neighbour_counts(frame(spark, points))) == wanted(points)


def test_counts_make_no_pairs(spark):
    points = parked(1200)
    found = spatial.neighbour_counts(frame(spark, points))
    assert {p[0]: n for p, n in counted(found)} == {k: k for k in range(1200)}
    assert joined(found) < 20 * len(points)


@pytest.mark.parametrize(("rows", "compared"), [(1, 1), (10, 7), (100, 100), (10_000, 10_000)])
def test_counts_do_not_depend_on_batches(monkeypatch, rows, compared):
    monkeypatch.setattr(counting, "ROWS", rows)
    monkeypatch.setattr(counting, "COMPARED", compared)
    points, edge, dealt = lattice(7, 200, 150), 4, []
    for p in points:
        x, y = cell(p)
        for bx in {(x + a) // edge for a in (-1, 0, 1)}:
            for by in {(y + a) // edge for a in (-1, 0, 1)}:
                dealt.append((bx, by, 0, 0, x, y, p[1], p[2], p[0], (bx, by) == (x // edge, y // edge), True))
    columns = [*counting.SORTED, "asks", "met"]
    table = pa.table({c: np.array(v) for c, v in zip(columns, zip(*sorted(dealt), strict=True), strict=True)})
    found = [row for batch in counting.earlier(iter(table.to_batches(max_chunksize=3)), edge, 7.0) for row in batch.to_pylist()]
    assert len(found) == len(points)
    by_id = {p[0]: p for p in points}
    assert sorted(((by_id[r["dst"]], r["n_neighbours"]) for r in found), key=repr) == wanted(points)


def paired(found):
    return sorted((r.src, r.dst, round(r.distance_m, 6)) for r in found.collect())


def wanted_pairs(points, reach=1):
    return sorted((src, dst, round(m, 6)) for src, dst, m in pairs(points, reach))


@pytest.mark.parametrize(("seed", "spread", "lat", "lon", "reach", "piece"), [(1, 40, 55.75, 37.61, 1, 256), (2, 4, 55.75, 37.61, 1, 3), (3, 30, -15e-5, -15e-5, 2, 1), (4, 100, -33.9, -70.6, 2, 2)])
def test_pairs_equal_the_loop(spark, monkeypatch, seed, spread, lat, lon, reach, piece):
    monkeypatch.setattr(spatial, "PIECE_IDS", piece)
    points = lattice(seed, 150, spread, lat, lon)
    assert paired(spatial.neighbour_pairs(frame(spark, points), reach=reach)) == wanted_pairs(points, reach)
    assert paired(spatial.neighbour_pairs(frame(spark, points), reach=reach, digits=6)) == wanted_pairs(points, reach)


def test_pairs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PIECE_IDS", 2)
    points = [(5, 55.75, 37.61), (5, 55.75, 37.61), (5, 55.75, 37.61), (5, 55.75001, 37.61), (1, 55.75, 37.61), (-3, 55.75, 37.61), (None, 55.75, 37.61), (None, 55.76, 37.61), (7, None, 37.61), (8, 55.75, None)]
    assert paired(spatial.neighbour_pairs(frame(spark, points))) == wanted_pairs(points)
    assert spatial.neighbour_pairs(frame(spark, [])).count() == 0


def test_pairs_of_copies_meet_as_places(spark):
    points = parked(600)
    found = spatial.neighbour_pairs(frame(spark, points))
    assert len(found.collect()) == 600 * 599 // 2
    assert joined(found) < len(points)
