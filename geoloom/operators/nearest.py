"""The k nearest vectors of many queries by dot product; nothing here needs Spark.

Products of matrices find the pairs that may be among the nearest; only those get
their similarity, a sum in double precision from the first dimension to the last,
as SQL has it.  It skips what is null or beyond the shorter vector, and is null if
nothing is left.  NaN is above all numbers, null below; ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Vectors and queries of one product, and pairs whose sums are made at once.
VECTORS, QUERIES, PAIRS = 2048, 256, 4096
#: Longer vectors are summed pair by pair, so that a product in single precision can't overflow.
LONGEST = 1e15
NONE, NULL, NUMBER, NAN = -1, 0, 1, 2


class Rows:
    """Ids and vectors of one width; what a vector lacks is 0 and not ``there``.

    A zero more or less changes no sum of numbers, so that only vectors without a
    first number or with others than finite ones are ``odd`` and need ``there``.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, there: np.ndarray) -> None:
        self.ids, self.values, self.there = ids, values, there
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((values * values).sum(axis=1))
        self.odd = ~(there[:, 0] & (self.norms < LONGEST))

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.ids[at], self.values[at], self.there[at])


def widest(vectors: pa.Array) -> int:
    return max(1, int(np.max(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), initial=0)))


def rows_of(ids: pa.Array, vectors: pa.Array, width: int) -> Rows:
    """Numbers beyond ``width``, which no query has, are left out."""
    sizes, flat = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), vectors.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values, there, near = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool), column < width
    values[row[near], column[near]] = flat.fill_null(0).to_numpy(zero_copy_only=False)[near]
    there[row[near], column[near]] = flat.is_valid().to_numpy(zero_copy_only=False)[near]
    return Rows(ids.to_numpy(zero_copy_only=False), values, there)


def distinct(rows: Rows, k: int) -> np.ndarray:
    """Of equal vectors, the rows with the ``k`` least ids besides any one id: no query can have others."""
    keys = np.ascontiguousarray(rows.values).view(np.dtype((np.void, rows.values.dtype.itemsize * rows.values.shape[1]))).ravel()
    group = np.unique(keys, return_inverse=True)[1]
    order = np.lexsort((rows.ids, group))
    first, new = np.ones(len(order), bool), np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    new[1:] = first[1:] | (rows.ids[order][1:] != rows.ids[order][:-1])
    number = np.cumsum(new)
    return order[number - number[first][np.cumsum(first) - 1] <= k]


def where(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of many flags of which few are set."""
    flags = flags.ravel()
    if len(flags) % 8:
        return np.flatnonzero(flags)
    eights = np.flatnonzero(flags.view(np.uint64))
    row, column = np.nonzero(flags.reshape(-1, 8)[eights])
    return eights[row] * 8 + column


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def sums_of_there(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``a`` and ``b``: sums and whether they are NULL, NUMBER or NAN."""
    out, some = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    with np.errstate(all="ignore"):
        for d in range(a.values.shape[1]):
            both = a.there[:, d, None] & b.there[None, :, d]
            out += np.where(both, a.values[:, d, None] * b.values[None, :, d], 0.0)
            some |= both
    kinds = np.where(some, np.where(np.isnan(out), NAN, NUMBER), NULL)
    return np.where(kinds == NUMBER, out, 0.0), kinds


class Nearest:
    """The best ``k`` of the vectors seen so far, for each query."""

    def __init__(self, queries: Rows, k: int) -> None:
        self.queries, self.k, self.seen = queries, k, 0
        self.ids, self.sums = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
        self.kinds = np.full((len(queries), k), NONE, np.int8)
        self.room = {np.dtype(x): np.empty(QUERIES * VECTORS, x) for x in (np.float32, np.float64)}
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = queries.values.astype(np.float32)
        self.usual, self.odd = np.flatnonzero(~queries.odd), np.flatnonzero(queries.odd)

    def _room(self, rows: int, columns: int, dtype: np.dtype) -> np.ndarray:
        """Memory for a product, the same for all of one type."""
        return self.room[dtype][: rows * columns].reshape(rows, columns)

    def _take(self, query: np.ndarray, ids: np.ndarray, found: np.ndarray, kinds: np.ndarray) -> None:
        """Puts rows in that are better than a query's last one."""
        last, low, id_ = self.kinds[query, -1], self.sums[query, -1], self.ids[query, -1]
        better = (kinds > last) | (kinds == last) & ((found > low) | (found == low) & (ids < id_))
        at = np.flatnonzero(better & (ids != self.queries.ids[query]))
        if not len(at):
            return
        of = np.unique(query[at])
        who = np.concatenate([np.repeat(of, self.k), query[at]])
        ids, found, kinds = (np.concatenate([x[of].ravel(), y[at]]) for x, y in ((self.ids, ids), (self.sums, found), (self.kinds, kinds)))
        order = np.lexsort((ids, -found, -kinds, who))
        who, ids, found, kinds = who[order], ids[order], found[order], kinds[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < self.k
        who, place = who[kept], place[kept]
        self.ids[who, place], self.sums[who, place], self.kinds[who, place] = ids[kept], found[kept], kinds[kept]

    def _may_enter(self, asked: np.ndarray, vectors: Rows, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that no error of a product keeps out; in double precision where single leaves many."""
        kinds, queries = self.kinds[asked, -1], self.queries
        floor = np.where(kinds == NAN, np.inf, np.where(kinds == NUMBER, self.sums[asked, -1], -np.inf))
        width, reach = vectors.values.shape[1], queries.norms[asked] * vectors.norms.max()
        for a, b in ((self.single, single), (queries.values, vectors.values)):
            slack = 2 * (width + 8) * float(np.finfo(b.dtype).eps) * reach + 1e-25
            with np.errstate(over="ignore"):
                bound = np.nextafter((floor - slack).astype(b.dtype), -np.inf, dtype=b.dtype)
            product = np.matmul(a[asked], b.T, out=self._room(len(asked), len(vectors), b.dtype))
            hits = where(product >= bound[:, None])
            if len(hits) * 16 <= len(asked) * len(vectors):
                break
        return asked[hits // len(vectors)], hits % len(vectors)

    def _usual(self, vectors: Rows) -> None:
        single = vectors.values.astype(np.float32)
        for k in range(0, len(self.usual), QUERIES):
            i, j = self._may_enter(self.usual[k : k + QUERIES], vectors, single)
            if len(i):
                found = np.concatenate([sums(self.queries.values[i[s : s + PAIRS]], vectors.values[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)])
                self._take(i, vectors.ids[j], found, np.full(len(i), NUMBER, np.int8))

    def _pair_by_pair(self, asked: np.ndarray, vectors: Rows) -> None:
        step = max(1, QUERIES * VECTORS // max(1, len(vectors)))
        for k in range(0, len(asked) if len(vectors) else 0, step):
            some = asked[k : k + step]
            found, kinds = sums_of_there(self.queries[some], vectors)
            self._take(np.repeat(some, len(vectors)), np.tile(vectors.ids, len(some)), found.ravel(), kinds.ravel())

    def add(self, vectors: Rows) -> None:
        """A few vectors come first, and then twice as many each time, so that few pairs enter that leave again."""
        self._pair_by_pair(self.odd, vectors)
        self._pair_by_pair(self.usual, vectors[vectors.odd])
        usual = vectors[~vectors.odd]
        usual = usual[distinct(usual, self.k)]
        usual, at = usual[np.argsort(-usual.norms, kind="stable")], 0
        while at < len(usual):
            step = min(VECTORS, max(16, 4 * self.k, self.seen))
            self._usual(usual[at : at + step])
            at, self.seen = at + step, self.seen + step

    def batch(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.kinds != NONE)
        found, kinds = np.where(self.kinds == NAN, np.nan, self.sums)[row, place], self.kinds[row, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries.ids[row], pa.int64()), pa.array(self.ids[row, place], pa.int64()), pa.array(found, pa.float64(), mask=kinds == NULL)],
            ["query_id", "vec_id", "similarity"],
        )


def nearest(asked: Callable[[], pa.Table], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the best ``k`` of a task's vectors for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = (c.combine_chunks() for c in asked().columns)
        width = widest(vectors)
        best, most = Nearest(rows_of(ids, vectors, width), k), max(1, min(VECTORS, (4 << 20) // width))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                best.add(rows_of(*batch.slice(at, most).columns, width))
        yield best.batch()

    return run
