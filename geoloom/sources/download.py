"""Idempotent downloads and their outcomes."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import url_missing
from .connector import http_session

CHUNK = 8_192


def download_file(url: str, destination: str | Path, *, timeout_sec: float = 30, retries: int = 3, backoff_sec: float = 1.5, session: Any = None, min_bytes: int = 10_000, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether the file is there, whole, in the end.

    A file of ``min_bytes`` or more is left alone.  Otherwise it is streamed into a
    name of this attempt's own and renamed, so attempts that run twice can't mix.
    A smaller one counts as a failure, and doesn't stay after the last attempt.
    """
    if retries < 1:
        raise ValueError("retries must be 1 or more")
    if min_bytes < 0:
        raise ValueError("min_bytes must be 0 or more")
    target = Path(destination)
    if target.exists() and target.stat().st_size >= min_bytes:
        return True
    target.parent.mkdir(parents=True, exist_ok=True)
    session = session or http_session()
    for attempt in range(1, retries + 1):
        part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
        try:
            answer = session.get(url, stream=True, timeout=timeout_sec)
            answer.raise_for_status()
            with part.open("wb") as out:
                for chunk in answer.iter_content(chunk_size=CHUNK):
                    if chunk:
                        out.write(chunk)
            if part.stat().st_size >= min_bytes:
                os.replace(part, target)
                return True
        except Exception:
            pass
        finally:
            part.unlink(missing_ok=True)
        if attempt < retries:
            sleep(backoff_sec * attempt)
    if target.exists() and target.stat().st_size < min_bytes:
        target.unlink()
    return False


def download_all(manifest: DataFrame, root: str = ".", connect: Callable = http_session, concurrent: int = 8, **options: Any) -> DataFrame:
    """id, url, status (ok, missing_url, download_failed) of each manifest row.

    Side effects survive task retries, since a finished file is skipped.  Write the
    result before using it twice.  ``root`` must be a folder that executors share.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = connect()
        for frame in frames:
            done = [download_file(u, os.path.join(root, p), session=session, **options) for u, p in zip(frame["url"], frame["image_path"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "url": frame["url"], "status": ["ok" if x else "download_failed" for x in done]})

    rows = manifest.select("id", F.col("download_url").alias("url"), "image_path")
    there = rows.where(~url_missing("url")).repartition(concurrent)
    missing = rows.where(url_missing("url")).select("id", "url", F.lit("missing_url").alias("status"))
    return there.mapInPandas(fetch, "id string, url string, status string").unionByName(missing)


def error_lines(outcomes: DataFrame) -> DataFrame:
    """The log's lines: status and id, and the url of a failed download, between tabs."""
    bad = outcomes.where("status != 'ok'")
    return bad.select(F.concat_ws("\t", "status", "id", F.when(F.col("status") == "download_failed", F.col("url"))).alias("value"))


def append_errors(outcomes: DataFrame, folder: str) -> None:
    error_lines(outcomes).write.mode("append").text(folder)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: ok (skipped ones included) and failed."""
    return outcomes.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
