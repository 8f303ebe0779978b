"""The jobs: ingest a provider, build the manifest, download, validate, preview."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FetchOptions, Settings
from ..operators import parse, preview, records, spatial, validate
from ..operators.grid import boxes, default_tiles
from ..schemas import MANIFEST
from ..sources import download, images
from ..sources.connector import SCHEMA, http_session, scan_tiles
from ..sources.raw_store import read_records
from ..tables import drop_written, exists, written


log = logging.getLogger(__name__)
#: Tiles whose answers are written at once: what a lost run has to ask again at most.
STEP_TILES = 200


def ingest(spark: SparkSession, provider: str, store: str, fetch: FetchOptions, tiles: DataFrame | None = None, token: str = "", concurrent: int = 4, connect: Callable = http_session, step_tiles: int = STEP_TILES) -> tuple[int, int]:
    """Adds what the provider has and the store lacks; returns new and total counts.

    The answers of every ``step_tiles`` tiles are written before the next are asked
    for; a run that died goes on, with the same tiles, where it stopped.  Records are seen only
    when their run is committed by a file of its number, which can be created but
    once: a run that dies leaves the store as it was, and of two at a time one fails.
    Tiles that failed are logged, and listed by :func:`failed_tiles`; the next run asks them again.
    """
    plan = list(enumerate(boxes(tiles if tiles is not None else default_tiles(spark))))
    committed = _committed(spark, store)
    number = len(committed)
    asked = hashlib.sha256(repr((provider, [b.query_text() for _, b in plan], fetch.limit, fetch.max_pages)).encode()).hexdigest()[:16]
    raw = f"{_raw_folder(store, number)}-{asked}"
    for first in range(0, len(plan), step_tiles):
        step = f"{raw}/step-{first}"
        if not exists(spark, f"{step}/_SUCCESS"):
            scan_tiles(spark, provider, plan[first : first + step_tiles], fetch, token, concurrent, connect).write.mode("overwrite").parquet(step)
    items = spark.read.schema(SCHEMA).parquet(*(f"{raw}/step-{k}" for k in range(0, len(plan), step_tiles))) if plan else spark.createDataFrame([], SCHEMA)
    failed = items.where("error is not null").count()
    if failed:
        log.warning("%d of %d tiles failed", failed, len(plan))
    parser = parse.parse_nested if provider == "nested" else parse.parse_flat
    found = parser(items.where("json is not null").select("tile_no", "item_no", "json")).withColumn("run", F.lit(number))
    old, order = _records(spark, store, committed), ["tile_no", "item_no"]
    fresh = records.keep_first(found, "id", order) if old is None else records.resume(old, found, "id", order)
    folder = uuid.uuid4().hex
    fresh.write.parquet(f"{store.rstrip('/')}/runs/{folder}")
    new = spark.read.parquet(f"{store.rstrip('/')}/runs/{folder}").count()
    _commit(spark, store, number, {"folder": folder, "raw": raw.rpartition("/")[2], "new": new, "failed_tiles": failed})
    return new, new + sum(x["new"] for x in committed)


def _raw_folder(store: str, number: int) -> str:
    return f"{store.rstrip('/')}/raw/{number:06d}"


def _committed(spark: SparkSession, store: str) -> list[dict]:
    """The commits of a store in their order: folder, raw, new, failed_tiles."""
    folder = f"{store.rstrip('/')}/commits"
    if not exists(spark, folder):
        return []
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("name")).orderBy("name").collect()
    return [json.loads(r.value) for r in rows]


def _commit(spark: SparkSession, store: str, number: int, what: dict) -> None:
    """Creates the run's file; an error if another run has done so."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/commits/{number:06d}.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(json.dumps(what).encode()))
    finally:
        out.close()


def _records(spark: SparkSession, store: str, committed: list[dict]) -> DataFrame | None:
    folders = [f"{store.rstrip('/')}/runs/{x['folder']}" for x in committed]
    return spark.read.parquet(*folders) if folders else None


def failed_tiles(spark: SparkSession, store: str) -> DataFrame:
    """run, tile_no, error of the tiles that a committed run couldn't read."""
    every = [spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{store.rstrip('/')}/raw/{x['raw']}").where("error is not null").select(F.lit(n).alias("run"), "tile_no", "error") for n, x in enumerate(_committed(spark, store)) if x["failed_tiles"]]
    return reduce(DataFrame.unionByName, every) if every else spark.createDataFrame([], "run int, tile_no long, error string")


def stored_records(spark: SparkSession, store: str) -> DataFrame:
    """A store's records in the order in which they were found; an array file has its own."""
    found = _records(spark, store, _committed(spark, store))
    if found is not None:
        return records.dense_order(found, "run", "tile_no", "item_no").drop("run", "tile_no", "item_no")
    return read_records(spark, store)


def build_manifest(spark: SparkSession, nested: DataFrame, flat: DataFrame, radius_m: float = 7.0, max_per_cluster: int = 2, exact_radius: bool = False) -> DataFrame:
    """Manifest rows, and ``ord``: provider A's records first, each source in its order."""
    united = records.unite(("mapillary", nested), ("kartaview", flat))
    rows = records.normalize(united, keep=("rank", "ord"))
    ordered = records.dense_order(rows.withColumnRenamed("ord", "_ord"), "rank", "_ord", into="ord").drop("rank", "_ord")
    return spatial.deduplicate(ordered, radius_m, max_per_cluster, exact_radius)


def write_manifest(manifest: DataFrame, path: str) -> None:
    columns = [f.name for f in MANIFEST.fields]
    manifest.orderBy("ord").select(columns).write.mode("overwrite").parquet(path)


def merge(spark: SparkSession, nested: str, flat: str, out: str, radius_m: float = 7.0, max_per_cluster: int = 2) -> int:
    """Builds the manifest of two stores; a missing one is empty.  Returns its rows."""
    write_manifest(build_manifest(spark, stored_records(spark, nested), stored_records(spark, flat), radius_m, max_per_cluster), out)
    return spark.read.parquet(out).count()


def run_download(spark: SparkSession, manifest: str, errors: str, settings: Settings, root: str = ".", connect: Callable = http_session) -> tuple[int, int]:
    found = download.download_all(spark.read.parquet(manifest), root, connect, retries=settings.download_retries, min_bytes=settings.min_image_bytes)
    found = written(found, "download-outcomes")
    download.append_errors(found, errors)
    ok, failed = download.outcome_counts(found).first()
    drop_written(found)
    return ok, failed


def run_validate(spark: SparkSession, manifest: str, images_folder: str, report: str, min_bytes: int = 10_000) -> dict:
    """Writes the whole report as JSON and returns its summary."""
    counts = validate.write_report(report, spark.read.parquet(manifest), images.scan(spark, images_folder), min_bytes)
    print(json.dumps(counts))
    return counts


def run_preview(spark: SparkSession, manifest: str, count: int, out: str, seed: int = 0) -> DataFrame:
    rows = spark.read.parquet(manifest)
    if count < 1:
        raise ValueError("count must be 1 or more")
    if rows.isEmpty():
        raise RuntimeError("the manifest is empty")
    placed = preview.layout(preview.sample(rows, count, seed=seed))
    preview.render(placed, min(count, rows.count()), out)
    return placed
