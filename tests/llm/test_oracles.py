"""The queries that SQL can express, against their twins."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from geoloom.llm import queries


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, sf_dir, name):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    found = queries.queries()[name](spark, sf_dir)
    want = db.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall()) and sorted(columns) == sorted(found.columns)
