"""``python -m geoloom.cli <command>``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import FLAT_FETCH, NESTED_FETCH, FetchOptions, Settings
from .plans import jobs
from .session import healthy, local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geoloom")
    top.add_argument("--local", action="store_true", help="run on this machine instead of the session that spark-submit gives")
    commands = top.add_subparsers(dest="command", required=True)
    for name, fetch in (("ingest-nested", NESTED_FETCH), ("ingest-flat", FLAT_FETCH)):
        one = commands.add_parser(name)
        one.add_argument("--store", required=True)
        one.add_argument("--limit-per-tile", type=int, default=fetch.limit)
        one.add_argument("--request-pause-sec", type=float, default=fetch.pause_sec)
        one.add_argument("--request-retries", type=int, default=fetch.retries)
        one.add_argument("--backoff-sec", type=float, default=fetch.backoff_sec)
        one.add_argument("--max-pages-per-tile", type=int, default=fetch.max_pages)
        one.add_argument("--concurrent-tiles", type=int, default=4)
    merge = commands.add_parser("merge")
    for name in ("--nested", "--flat", "--out"):
        merge.add_argument(name, required=True)
    merge.add_argument("--dedup-radius-m", type=float, default=7.0)
    merge.add_argument("--max-per-cluster", type=int, default=2)
    get = commands.add_parser("download")
    for name in ("--manifest", "--errors"):
        get.add_argument(name, required=True)
    get.add_argument("--root", default=".")
    get.add_argument("--retries", type=int, default=3)
    get.add_argument("--min-size-bytes", type=int, default=10_000)
    check = commands.add_parser("validate")
    for name in ("--manifest", "--images", "--report"):
        check.add_argument(name, required=True)
    check.add_argument("--min-size-bytes", type=int, default=10_000)
    show = commands.add_parser("preview")
    for name in ("--manifest", "--out"):
        show.add_argument(name, required=True)
    show.add_argument("--count", type=int, default=20)
    commands.add_parser("health")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session() if a.local else SparkSession.builder.appName("geoloom").getOrCreate()
    if a.command.startswith("ingest"):
        fetch = FetchOptions(a.limit_per_tile, a.request_pause_sec, a.request_retries, a.backoff_sec, a.max_pages_per_tile)
        print(jobs.ingest(spark, a.command.removeprefix("ingest-"), a.store, fetch, token=Settings().nested_token, concurrent=a.concurrent_tiles))
    elif a.command == "merge":
        print(jobs.merge(spark, a.nested, a.flat, a.out, a.dedup_radius_m, a.max_per_cluster))
    elif a.command == "download":
        print(jobs.run_download(spark, a.manifest, a.errors, Settings(download_retries=a.retries, min_image_bytes=a.min_size_bytes), a.root))
    elif a.command == "validate":
        jobs.run_validate(spark, a.manifest, a.images, a.report, a.min_size_bytes)
    elif a.command == "preview":
        jobs.run_preview(spark, a.manifest, a.count, a.out)
    else:
        print(healthy(spark))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
