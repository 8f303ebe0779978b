from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents from texts, numbered from 0, with columns whose names clash with operators'."""

    def make(texts, **more):
        rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
        made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return made.withColumns({k: F.lit(v) for k, v in more.items()})

    return make
