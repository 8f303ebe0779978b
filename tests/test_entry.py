from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert e.entry(spark).columns == ["ord", "lat", "lon"]
    assert set(e.oracle_sql()) <= set(e.queries())


STANDS = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and 'spatial_dedup' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"


def _copied(to: Path) -> Path:
    """The library without the optional folders and the pipeline."""
    for name in ("geoloom", "tests"):
        shutil.copytree(ROOT / name, to / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def test_the_rest_stands_alone(tmp_path):
    """Without the optional subpackage the entry still imports."""
    subprocess.run([sys.executable, "-c", STANDS], cwd=_copied(tmp_path), check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_a_missing_dependency_of_the_optional_part_costs_that_part_alone():
    if not (ROOT / "geoloom" / "llm").exists():
        pytest.skip("the optional part is deleted")
    block = "import sys; sys.modules['public_tokenizers'] = None; "
    subprocess.run([sys.executable, "-c", block + STANDS], cwd=ROOT, check=True)
