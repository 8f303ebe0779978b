"""Stand-ins for the world outside: two providers, a file server and a folder of images.

They answer from arithmetic alone, so that the connectors, the downloads and the
image scans run in queries whose results SQL can tell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.preview import png
from ..tables import writing

#: A tile's number is its west edge in hundredths of a degree.  Tile t has t % 7 items, three to a page.
TILES, PAGE = 24, 3


class Answer:
    def __init__(self, status: int = 200, payload: object = None, body: bytes = b""):
        self.status_code, self.payload, self.body = status, payload, body

    def raise_for_status(self) -> None:
        if self.status_code >= 400:
            raise OSError(f"status {self.status_code} for https://provider/items?access_token=hidden")

    def json(self) -> object:
        return self.payload

    def close(self) -> None:
        pass

    def iter_content(self, chunk_size: int):
        return (self.body[k : k + chunk_size] for k in range(0, len(self.body), chunk_size))


class Providers:
    """Both providers.  Tiles of 5, 16, 27 ... are not there; every third answers at the second attempt only."""

    def __init__(self) -> None:
        self.asked: set = set()

    def get(self, url: str, params: dict, timeout: float) -> Answer:
        if "?cursor=" in url:
            tile, page = map(int, url.rpartition("=")[2].split("."))
        else:
            tile, page = round(float(params["bbox"].split(",")[0]) * 100), int(params.get("page", 1)) - 1
        if tile % 11 == 5:
            return Answer(404)
        if tile % 3 == 0 and (tile, page) not in self.asked:
            self.asked.add((tile, page))
            return Answer(503)
        items, last = range(tile % 7)[page * PAGE : (page + 1) * PAGE], (page + 1) * PAGE >= tile % 7
        if "access_token" in params or "?cursor=" in url:
            return Answer(payload={"data": [self.nested(tile, k) for k in items], "paging": {} if last else {"next": f"https://provider/items?cursor={tile}.{page + 1}"}})
        return Answer(payload={"result": {"data": [self.flat(tile, k) for k in items], "hasMore": not last}})

    @staticmethod
    def key(tile: int, item: int) -> str:
        """Items 4 and 5 of a tile are those of the tile before, too."""
        return f"i{tile - 1}.{item - 3}" if item > 3 else f"i{tile}.{item}"

    def nested(self, tile: int, item: int) -> dict:
        return {"id": self.key(tile, item), "geometry": {"coordinates": [tile / 100, 1 + item / 4]}, "thumb_2048_url": f"u{item}", "sequence": {"id": tile}}

    def flat(self, tile: int, item: int) -> dict:
        return {"photoId": self.key(tile, item), "gpsLat": str(1 + item / 4), "lng": tile / 100, "fileurl": f"u{item}", "dateAdded": f"d{tile}"}


def tiles(spark: SparkSession) -> DataFrame:
    west = F.col("id") / 100
    return spark.range(TILES).select(F.col("id").alias("tile_no"), F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("max_lat"), west.alias("min_lon"), (west + 0.01).alias("max_lon"))


class Files:
    """A file server: the size is in the url, ``bad`` is an error, ``late`` comes at the second attempt."""

    def __init__(self) -> None:
        self.asked: set = set()

    def get(self, url: str, stream: bool, timeout: float) -> Answer:
        kind, _, size = url.partition("-")
        if kind == "bad" or (kind == "late" and url not in self.asked):
            self.asked.add(url)
            return Answer(503)
        return Answer(body=b"i" * int(size))


def images(spark: SparkSession, folder: str, n: int = 12) -> None:
    """Files 0 to n - 1: whole images whose sides grow, but every third one is cut and every fourth one missing."""
    for k in range(n):
        whole = png(np.full((40 + 10 * k, 400, 3), 20 * k, dtype=np.uint8))
        if k % 4 != 3:
            with writing(spark, f"{folder}/{k}.png") as write:
                write(whole[:60] if k % 3 == 1 else whole)
