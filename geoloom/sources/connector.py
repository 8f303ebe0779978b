"""Both providers as a Spark data source: a partition is a run of tiles."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import FetchOptions
from ..operators.grid import BBox
from .paging import flat_items, nested_items

SCHEMA = "tile_no long, item_no long, json string, error string"


def http_session():
    import requests

    return requests.Session()


@dataclass
class TileRun(InputPartition):
    tiles: list

    def __init__(self, tiles: list):
        super().__init__(None)
        self.tiles = tiles


def shown_error(error: Exception, token: str = "") -> str:
    """An error's kind and text without the queries of its urls and without the token."""
    text = re.sub(r"\?[^\s'\"<>)]*", "?", f"{type(error).__name__}: {error}")
    return text.replace(token, "...") if token else text


class TileReader(DataSourceReader):
    def __init__(self, provider: str, token: str, tiles: list, fetch: FetchOptions, runs: int, connect: Callable):
        self.provider, self.token, self.tiles, self.fetch, self.runs, self.connect = provider, token, tiles, fetch, runs, connect

    def partitions(self) -> list[TileRun]:
        runs = max(1, min(self.runs, len(self.tiles)))
        return [TileRun(self.tiles[k::runs]) for k in range(runs)]

    def read(self, partition: TileRun) -> Iterator[tuple]:
        """Items of a tile in order; a failing tile ends in a row with its error.

        The error is a row and not an exception, since a task that failed would
        ask for all its tiles again.
        """
        session = self.connect()
        for number, box in partition.tiles:
            tile, k = BBox(*box), 0
            try:
                items = nested_items(session, self.token, tile, self.fetch) if self.provider == "nested" else flat_items(session, tile, self.fetch)
                for item in items:
                    yield number, k, json.dumps(item, ensure_ascii=False), None
                    k += 1
            except Exception as error:
                yield number, k, None, shown_error(error, self.token)
            time.sleep(self.fetch.pause_sec)


def tile_source(name: str, provider: str, tiles: list[tuple[int, BBox]], fetch: FetchOptions, token: str = "", concurrent: int = 4, connect: Callable = http_session) -> type[DataSource]:
    """A data source class for :func:`scan_tiles`; ``concurrent`` bounds the request rate."""
    listed = [(n, (b.min_lat, b.max_lat, b.min_lon, b.max_lon)) for n, b in tiles]

    class TileSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return TileReader(provider, token, listed, fetch, concurrent, connect)

    return TileSource


def scan_tiles(spark: SparkSession, provider: str, tiles: list[tuple[int, BBox]], fetch: FetchOptions, token: str = "", concurrent: int = 4, connect: Callable = http_session) -> DataFrame:
    """tile_no, item_no, json, error of all tiles.  ``connect`` makes a session on an executor."""
    if provider not in ("nested", "flat"):
        raise ValueError("provider is nested or flat")
    if provider == "nested" and not token:
        raise ValueError("the nested provider needs a token")
    name = f"geoloom_tiles_{provider}"
    spark.dataSource.register(tile_source(name, provider, tiles, fetch, token, concurrent, connect))
    return spark.read.format(name).load()
