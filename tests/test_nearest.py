"""The k nearest vectors by blocks, against SQL and a plain loop."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from geoloom.operators import nearest, retrieval
from geoloom.plans import catalogue


def _sum(a, b):
    """As SQL sums: from the first dimension on, without what is null or beyond the shorter one."""
    out = None
    for x, y in zip(a or [], b or []):
        if x is not None and y is not None:
            out = (out or 0.0) + float(x) * float(y)
    return out


def _rank(s):
    return (2, 0.0) if s is None else (0, 0.0) if math.isnan(s) else (1, -s)


def _loop(queries, vectors, k):
    out = []
    for q, a in queries:
        found = sorted((_rank(s := _sum(a, b)), v, s) for v, b in vectors if v != q)[:k]
        out += [(q, v, None if s is None else "nan" if math.isnan(s) else s) for _, v, s in found]
    return sorted(out, key=repr)


def _blocks(queries, vectors, k, batch=50):
    def table(rows):
        return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})

    (found,) = nearest.nearest(lambda: table(queries), k)(iter(table(vectors).to_batches(max_chunksize=batch)))
    rows = zip(*(found.column(c).to_pylist() for c in ("query_id", "vec_id", "similarity")))
    return sorted(((q, v, "nan" if s is not None and math.isnan(s) else s) for q, v, s in rows), key=repr)


def _random(n, width, seed):
    made = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    return [(k, [float(x) for x in row]) for k, row in enumerate(made)]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_sums_and_ties_are_those_of_a_loop(k):
    rows = _random(300, 16, 1)
    rows += [(1000 - n, rows[n % 7][1]) for n in range(200)]  # copies with greater ids, which come in falling order
    rows += [(2000 + n, rows[n % 90][1][::-1]) for n in range(90)]
    asked = rows[::9]
    assert _blocks(asked, rows, k) == _loop(asked, rows, k)


def test_dims_in_another_order_tie_only_as_their_sums_do():
    """Sums of the same products that differ by rounding alone: no product of matrices may decide."""
    asked, values = [(0, [float(np.float32(0.1))] * 32)], np.linspace(-1, 1.3, 32).astype(np.float32)
    rows = asked + [(n + 1, [float(x) for x in np.random.default_rng(n).permutation(values)]) for n in range(500)]
    assert _blocks(asked, rows, 5) == _loop(asked, rows, 5)


def test_odd_vectors():
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [None, 2.0]), (4, [nan, 1.0]), (5, [inf, -1.0]), (6, [-inf, inf]), (7, [1.0]), (8, [1.0, None, 5.0, 7.0]),
            (9, [0.0, 0.0, 0.0]), (10, [None, None, None]), (11, [3e38, 1.0]), (12, [-3e38, 1.0]), (13, [1e-40, 1e-44]), (14, [-0.0]), (15, [None, inf]), (16, [2.0, 1.0, 0.5])]
    rows = [(n, v and [x if x is None else float(np.float32(x)) for x in v]) for n, v in rows] + [(20 + n, v) for n, v in _random(40, 3, 2)]
    for k in (2, 30):
        assert _blocks(rows, rows, k, 13) == _loop(rows, rows, k)


def test_repeated_ids_and_equal_vectors():
    rows = [(n % 4, [1.0, float(n % 2)]) for n in range(60)] + [(9, [1.0, 0.0])] * 2
    for k in (1, 3, 20):
        assert _blocks(rows[:8], rows, k) == _loop(rows[:8], rows, k)


def test_many_ties_of_different_vectors():
    rows = [(n, [float(x) for x in np.random.default_rng(n).integers(0, 2, 10)]) for n in range(400)]
    assert _blocks(rows[::3], rows, 3, 90) == _loop(rows[::3], rows, 3)


def test_pairs_that_are_summed_stay_few(monkeypatch):
    """A plain cross join sums all pairs."""
    summed, sums = [], nearest.sums
    monkeypatch.setattr(nearest, "sums", lambda a, b: summed.append(len(a)) or sums(a, b))
    rows = _random(4000, 16, 3)
    _blocks(rows[::10], rows, 3, 1000)
    assert sum(summed) < 400 * 4000 // 20


def test_no_join_makes_the_pairs(spark):
    v = spark.createDataFrame(_random(50, 4, 4), "vec_id long, embedding array<float>")
    plan = retrieval.top_k(v.where("vec_id % 10 = 0"), v, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "nearest" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["topk_similar", "locate", "locate_explained"])
def test_odd_tables_equal_sql(spark, tmp_path, name):
    rows = _random(400, 8, 5)
    rows += [(400 + n, rows[n % 100][1]) for n in range(150)]
    rows += [(600, None), (601, []), (700, [None, 1.0]), (701, [1.0, None] * 4), (702, [0.5] * 3), (800, [0.25] * 11), (900, [1.0]), (None, [9.0] * 8), (7, rows[8][1]), (300, rows[9][1])]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    found = catalogue.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    plain = lambda t: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in t), key=repr)
    assert plain(found) == plain(want.fetchall())


def test_ids_that_are_no_whole_numbers(spark):
    v = spark.createDataFrame(_random(40, 4, 6), "vec_id long, embedding array<float>")
    named = v.selectExpr("lpad(string(vec_id), 3, '0') as vec_id", "embedding")
    want = [(r.query_id, r.vec_id, r.similarity) for r in retrieval.top_k(v, v, 3).orderBy("query_id", "rank").collect()]
    assert [(int(r.query_id), int(r.vec_id), r.similarity) for r in retrieval.top_k(named, named, 3).orderBy("query_id", "rank").collect()] == want
