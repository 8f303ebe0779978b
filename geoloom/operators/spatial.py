"""Neighbour pairs on a hash grid, and order-respecting spatial deduplication."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalar import EARTH_RADIUS_M, LAT_METRES, LON_METRES, cell, haversine_m
from ..tables import Scratch, small, written
from . import counting


#: Ids of one place that a row of the join holds at most; Spark holds the pairs of two such rows at once.
PIECE_IDS = 256


def _forward(n: int) -> Column:
    """The steps to a cell itself and to half of those around it, so that two cells meet once."""
    steps = range(-n, n + 1)
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps if (a, b) >= (0, 0)))


def neighbour_pairs(points: DataFrame, radius_m: float = 7.0, reach: int = 1, order: str = "ord", digits: int | None = None) -> DataFrame:
    """src, dst, distance_m of points within the radius and ``reach`` cells, src first in order.

    Points of one place are folded.  One side is exploded into the cells around it and
    joined on the cell, so that only places of neighbouring cells meet, each two of them
    once; their distance, rounded if ``digits`` are given, holds for all pairs of their points.
    With one cell of reach, points that are close but two cells apart aren't pairs; two cells of reach find all.
    """
    cx, cy = cell("lat", "lon", radius_m)
    places = points.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.sort_array(F.collect_list(order)).alias("ids"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(PIECE_IDS)), lambda k: F.slice("ids", k + 1, PIECE_IDS))
    places = places.where(F.size("ids") > 0).select("lat", "lon", cx.alias("cx"), cy.alias("cy"), F.posexplode(pieces).alias("piece", "ids"))
    near = places.select("cx", "cy", *(F.col(c).alias(f"{c}_d") for c in ("lat", "lon", "piece", "ids")))
    around = places.select("*", F.explode(_forward(reach)).alias("o"))
    around = around.select((F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), (F.expr("o.a = 0 and o.b = 0")).alias("own"), *(F.col(c).alias(f"{c}_s") for c in ("lat", "lon", "piece", "ids")))
    once = "not own or lat_s < lat_d or lat_s = lat_d and (lon_s < lon_d or lon_s = lon_d and piece_s <= piece_d)"
    # A lambda ends generated code, which otherwise holds the pairs of all the rows that one row meets.
    same = F.forall(F.array(F.expr("own and lat_s = lat_d and lon_s = lon_d and piece_s = piece_d")), lambda x: x)
    distance = haversine_m("lat_d", "lon_d", "lat_s", "lon_s")
    met = near.join(around, ["cx", "cy"]).where(once).where(distance <= radius_m)
    met = met.select("ids_s", "ids_d", same.alias("same"), (distance if digits is None else F.round(distance, digits)).alias("distance_m"))
    pairs = met.select("*", F.explode("ids_s").alias("p")).select("ids_d", "same", "distance_m", "p", F.explode("ids_d").alias("q"))
    return pairs.where("p < q or p > q and not same").select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), "distance_m")


#: Cells along the edge of a block in the first round; every round doubles it.
BLOCK_CELLS = 256
#: Points of a block that one task decides.
MOST_POINTS = 4_000_000
#: Undecided points that a point is compared with before it is left to the next round.
MOST_DOUBTS = 256
STATES = "ord long, lat double, lon double, x long, y long, state int"


def _half(lat: str, lon: str, radius_m: float) -> list[Column]:
    """A quarter of a cell.  Points of one are neighbours at any latitude: its diagonal is below the radius."""
    return [F.floor(F.col(lat) / (radius_m / LAT_METRES / 2)).alias("hx"), F.floor(F.col(lon) / (radius_m / LON_METRES / 2)).alias("hy")]


def _blocks(points: DataFrame, edge: int, shift: int, halo: int) -> DataFrame:
    """``points``, once for each block (bx, by) that they lie in or, by at most ``halo`` cells, beside; ``inner`` tells which."""
    def of(name: str) -> Column:
        own = F.floor((F.col(name) + shift) / edge)
        sides = [F.floor((F.col(name) + shift + d) / edge) for d in (-halo, halo)]
        return F.transform(F.array_distinct(F.array(own, *sides)), lambda x: F.struct(x.alias("b"), (x == own).alias("own")))

    placed = points.withColumn("_x", F.explode(of("x"))).withColumn("_y", F.explode(of("y")))
    return placed.select(*points.columns, F.col("_x.b").alias("bx"), F.col("_y.b").alias("by"), (F.col("_x.own") & F.col("_y.own")).alias("inner"))


def _decided(frame: pd.DataFrame, radius_m: float, most: int, reach: int) -> pd.DataFrame:
    """The undecided inner points of a block with their state: 1 kept, -1 gone, 0 still open.

    Points are taken in order.  What the block sees of points beyond its edge is
    in doubt until they are decided themselves, and so are points that depend on them.
    """
    frame = frame.sort_values("ord", kind="stable")
    lat, lon = frame["lat"].to_numpy(), frame["lon"].to_numpy()
    quarters = [np.floor(v / (radius_m / metres / 2)).tolist() for v, metres in ((lat, LAT_METRES), (lon, LON_METRES))]
    kept, doubts, full, unsure = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int)
    around = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    radians, sin, asin, sqrt = math.radians, math.sin, math.asin, math.sqrt

    def near(a: tuple, b: tuple) -> bool:
        chord = sin(radians(a[0] - b[0]) / 2) ** 2 + a[2] * b[2] * sin(radians(a[1] - b[1]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * asin(sqrt(chord)) <= radius_m

    states = []
    places = zip(lat.tolist(), lon.tolist(), np.cos(np.radians(lat)).tolist(), strict=True)
    rows = zip(places, zip(frame["x"].tolist(), frame["y"].tolist(), strict=True), zip(*quarters, strict=True), frame["inner"].tolist(), frame["state"].tolist(), strict=True)
    for place, (x, y), quarter, inner, state in rows:
        if state == 0 and inner:
            have = full[quarter]
            if have < most:
                cells = [(x + a, y + b) for a, b in around]
                have = sum(near(place, other) for at in cells for other in kept.get(at, ()))
            if have >= most:
                state = -1
            elif have + unsure[quarter] < most:
                doubted = itertools.chain.from_iterable(doubts.get(at, ()) for at in cells)
                lack = most - have - sum(near(place, other) for other in itertools.islice(doubted, MOST_DOUBTS))
                state = int(lack > 0 and next(doubted, None) is None)
        states.append(state)
        if state == 1:
            kept[x, y].append(place)
            full[quarter] += 1
        elif state == 0:
            doubts[x, y].append(place)
            unsure[quarter] += 1
    frame = frame.assign(now=states)
    frame = frame[frame["inner"] & (frame["state"] == 0)]
    return frame[["ord", "lat", "lon", "x", "y"]].assign(state=frame["now"].astype("int32"))


def _solved(points: DataFrame, accepted: DataFrame | None, radius_m: float, most: int, reach: int, keep: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Kept and rejected points, as tables of every round, given those that were accepted before."""
    open_points, kept, gone, edge, turn = points, [] if accepted is None else [accepted], [], BLOCK_CELLS, 0
    known = len(kept)
    while True:
        shift = edge // 2 if turn % 2 else 0
        placed = _blocks(open_points.withColumn("state", F.lit(0)), edge, shift, reach)
        if kept:
            here = small(keep(placed.select("bx", "by").distinct(), "blocks"), 48)
            before = _blocks(reduce(DataFrame.unionByName, kept).withColumn("state", F.lit(1)), edge, shift, reach)
            placed = placed.unionByName(before.join(here, ["bx", "by"], "left_semi").select(placed.columns))
        decided = keep(placed.groupBy("bx", "by").applyInPandas(lambda f: _decided(f, radius_m, most, reach), STATES), "decided")
        kept.append(decided.where("state = 1").drop("state"))
        gone.append(decided.where("state = -1").select("ord"))
        open_points = decided.where("state = 0").drop("state")
        if open_points.isEmpty():
            return kept[known:], gone
        edge, turn = 2 * edge, turn + 1


def deduplicate(points: DataFrame, radius_m: float = 7.0, max_per_cluster: int = 2, exact_radius: bool = False, order: str = "ord", accepted: DataFrame | None = None) -> DataFrame:
    """Keeps a point if fewer than ``max_per_cluster`` kept points before it are neighbours.

    This is what a loop in ``order`` (a total one) would keep.  ``accepted`` are
    kept points before all of these.  The plane is cut into blocks of cells, and a
    task decides a block's points in their order; those that depend on undecided
    points beyond the edge wait.  Every round doubles the blocks and shifts them, so that
    a chain of points across the whole plane takes as many rounds as it has doublings.

    No pairs are made.  A block with more than ``MOST_POINTS`` is decided by runs of
    the order, each halved until it fits: what falls into a quarter of a cell that
    holds its cap already is rejected by a join before a run is dealt out.  Points
    without a place have no neighbours.  Every round is a table in the checkpoint
    folder, and a lost executor costs a reread.
    """
    if max_per_cluster < 1:
        raise ValueError("max_per_cluster must be 1 or more")
    if radius_m <= 0:
        return points
    reach = 2 if exact_radius else 1

    def placed(rows: DataFrame) -> DataFrame:
        x, y = cell("lat", "lon", radius_m)
        rows = rows.select(F.col(order).cast("long").alias("ord"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        return rows.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("*", x.alias("x"), y.alias("y"))

    with Scratch(points.sparkSession, "deduplicate") as keep:
        everything = keep(placed(points), "points")
        kept, gone, runs = [] if accepted is None else [keep(placed(accepted), "accepted")], [], [(None, None)]
        while runs:
            low, high = runs.pop()
            run = everything if low is None else everything.where(F.col("ord") > low)
            run = run if high is None else run.where(F.col("ord") <= high)
            if kept:
                before = reduce(DataFrame.unionByName, kept)
                full = before.groupBy(*_half("lat", "lon", radius_m)).agg(F.count("*").alias("n")).where(F.col("n") >= max_per_cluster).select("hx", "hy")
                marked = run.select("*", *_half("lat", "lon", radius_m)).join(small(keep(full.withColumn("full", F.lit(True)), "full"), 48), ["hx", "hy"], "left")
                marked = keep(marked.select(*run.columns, F.coalesce("full", F.lit(False)).alias("full")), "run")
                gone.append(marked.where("full").select("ord"))
                run = marked.where("not full").drop("full")
            largest = run.groupBy(F.floor(F.col("x") / BLOCK_CELLS), F.floor(F.col("y") / BLOCK_CELLS)).count().agg(F.max("count")).first()[0] or 0
            if largest > MOST_POINTS:
                middle, first, last = run.agg(F.percentile_approx("ord", 0.5), F.min("ord"), F.max("ord")).first()
                if first < last:
                    middle = min(middle, last - 1)
                    runs += [(middle, high), (low, middle)]
                    continue
            if largest:
                more, rejected = _solved(run, reduce(DataFrame.unionByName, kept) if kept else None, radius_m, max_per_cluster, reach, keep)
                kept, gone = kept + more, gone + rejected
        rejected = written(reduce(DataFrame.unionByName, gone), "rejected-points") if gone else None
    if rejected is None:
        return points
    return points.join(small(rejected.withColumnRenamed("ord", "_gone"), 16), F.col(order) == F.col("_gone"), "left_anti").select(*points.columns)


#: Cells along the edge of a block of counts, and points of it that one group holds.
COUNT_CELLS, COUNT_POINTS = 4, 500_000


def _earlier(points: DataFrame, radius_m: float, order: str) -> DataFrame:
    """dst, n_neighbours by block of cells.  The points of a large block are dealt into parts, and each two of them meet."""
    x, y = cell("lat", "lon", radius_m)
    rows = points.where(F.col(order).isNotNull() & F.expr("lat is not null and lon is not null"))
    rows = rows.select(F.col(order).cast("long").alias("ord"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), x.alias("x"), y.alias("y"))
    placed = _blocks(rows, COUNT_CELLS, 0, 1)
    large = placed.groupBy("bx", "by").count().where(F.col("count") > COUNT_POINTS).select("bx", "by", F.ceil(F.col("count") / COUNT_POINTS).alias("parts"))
    placed = placed.join(F.broadcast(large), ["bx", "by"], "left")  # at most one for COUNT_POINTS rows
    placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")))

    def asking(k: Column) -> Column:
        return F.struct(F.col("part").alias("i"), k.alias("j"), F.col("inner").alias("asks"), (k == F.col("part")).alias("met"))

    def asked(k: Column) -> Column:
        return F.struct(k.alias("i"), F.col("part").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("met"))

    parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    meetings = F.concat(F.transform(parts, asking), F.transform(F.filter(parts, lambda k: k != F.col("part")), asked))
    dealt = placed.select("*", F.explode(meetings).alias("m")).select("bx", "by", "m.i", "m.j", "x", "y", "lat", "lon", "ord", "m.asks", "m.met").where("asks or met")
    found = dealt.repartition(*counting.BLOCK).sortWithinPartitions(*counting.SORTED).mapInArrow(lambda batches: counting.earlier(batches, COUNT_CELLS, radius_m), counting.COUNTS)
    return found.groupBy("dst").agg(F.sum("n_neighbours").alias("n_neighbours"))


def neighbour_counts(points: DataFrame, radius_m: float = 7.0, order: str = "ord") -> DataFrame:
    """How many earlier neighbours each point has.

    No pairs of points are made where ``order`` is a whole number: the ids of the
    places around a place are sorted, and its own are looked up among them.
    """
    if isinstance(points.schema[order].dataType, IntegralType):
        counts = _earlier(points, radius_m, order)
    else:
        counts = neighbour_pairs(points, radius_m, order=order).groupBy("dst").agg(F.count("*").alias("n_neighbours"))
    return points.join(counts.withColumnRenamed("dst", order), order, "left").fillna(0, ["n_neighbours"])
