"""Earlier neighbours of points, counted by block; nothing here needs Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.scalar import EARTH_RADIUS_M

#: What names a block, and the order in which its rows come.
BLOCK = ["bx", "by", "i", "j"]
SORTED = [*BLOCK, "x", "y", "lat", "lon", "ord"]
#: Rows of whole blocks that are counted at once, and places or ids compared at once.
ROWS, COMPARED = 200_000, 1 << 20
COUNTS = "dst long, n_neighbours long"


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` sorted keys begins, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs whose sizes sum up to ``most``, or of one."""
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield slice(k, to)
        k = to


def _near(lat: np.ndarray, lon: np.ndarray, cos: np.ndarray, i: np.ndarray, j: np.ndarray, radius_m: float) -> np.ndarray:
    chord = np.sin(np.radians(lat[j] - lat[i]) / 2) ** 2 + cos[i] * cos[j] * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(chord)) <= radius_m


def _of_blocks(rows: dict[str, np.ndarray], edge: int, radius_m: float) -> pa.RecordBatch:
    """``rows`` are sorted.  A point that ``asks`` gets the number of those ``met`` near it with a lower id.

    Points of one place are compared with other places as one; the ids of the places
    near it are then sorted, and its own ids looked up among them.
    """
    block, width = np.cumsum(_changes([rows[c] for c in BLOCK])) - 1, edge + 2
    cells = (block * width + rows["x"] - rows["bx"] * edge + 1) * width + rows["y"] - rows["by"] * edge + 1
    new = _changes([cells, rows["lat"], rows["lon"]])
    place, first = np.cumsum(new) - 1, np.flatnonzero(new)
    cell, lat, lon = (v[first] for v in (cells, rows["lat"], rows["lon"]))
    cos = np.cos(np.radians(lat))
    ids, rank = np.unique(rows["ord"], return_inverse=True)
    n, asks, met = len(ids), rows["asks"], rows["met"]
    own_place, own_rank, own_at = place[asks], rank[asks], _starts(place[asks], len(first))
    other_rank, other_at = rank[met], _starts(place[met], len(first))

    asking = np.flatnonzero(np.diff(own_at))
    beside = cell[asking][:, None] + np.array([-width, 0, width])
    low, high = np.searchsorted(cell, (beside - 1).ravel(), "left"), np.searchsorted(cell, (beside + 1).ravel(), "right")
    owner, counts = np.repeat(asking, 3), np.zeros(len(own_rank), np.int64)
    for part in _portions(high - low, COMPARED):
        i, j = np.repeat(owner[part], (high - low)[part]), _ranges(low[part], (high - low)[part])
        near = _near(lat, lon, cos, i, j, radius_m)
        i, j = i[near], j[near]
        sizes = other_at[j + 1] - other_at[j]
        for run in _portions(sizes, COMPARED):
            found = np.repeat(i[run], sizes[run]) * n + other_rank[_ranges(other_at[j[run]], sizes[run])]
            found.sort()
            for_places = np.unique(i[run])
            at = _ranges(own_at[for_places], own_at[for_places + 1] - own_at[for_places])
            base = own_place[at] * n
            counts[at] += np.searchsorted(found, base + own_rank[at]) - np.searchsorted(found, base)
    return pa.RecordBatch.from_arrays([pa.array(rows["ord"][asks]), pa.array(counts)], ["dst", "n_neighbours"])


def earlier(batches: Iterator[pa.RecordBatch], edge: int, radius_m: float) -> Iterator[pa.RecordBatch]:
    """Counts of the blocks in ``batches``, sorted as above; whole blocks are taken together."""

    def counted(table: pa.Table) -> pa.RecordBatch:
        return _of_blocks({c: table[c].to_numpy() for c in table.column_names}, edge, radius_m)

    held: list[pa.RecordBatch] = []
    waiting, most = 0, ROWS
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= most:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes([table[c].to_numpy() for c in BLOCK]))[-1])
            if last:
                yield counted(table.slice(0, last))
            held = table.slice(last).to_batches()
            waiting -= last
            most = max(ROWS, 2 * waiting)
    if waiting:
        yield counted(pa.Table.from_batches(held))
