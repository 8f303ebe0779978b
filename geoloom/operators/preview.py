"""A sample of a manifest and its place in a collage."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..tables import exists, writing

COLUMNS, THUMB_WIDTH, THUMB_HEIGHT = 4, 320, 180


def sample(rows: DataFrame, n: int, key: str = "id", seed: int | str = 0) -> DataFrame:
    """min(count, n) rows, the first by a hash of key and seed, with ``idx`` from 0.

    The order is that of a random draw, yet the same for the same seed.  Only n
    rows reach the task that numbers them.
    """
    if n < 1:
        raise ValueError("count must be 1 or more")
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    few = rows.withColumn("_draw", draw).orderBy("_draw", key).limit(n)
    taken = few.agg(F.array_sort(F.collect_list(F.struct("_draw", F.struct(*rows.columns).alias("row")))).alias("r"))
    return taken.select(F.posexplode("r").alias("idx", "x")).select("idx", "x.row.*")


def layout(sampled: DataFrame) -> DataFrame:
    """The slot of each sampled row; rows without a usable place leave theirs blank."""
    lat, lon = (F.expr(f"try_cast(trim(cast({x} as string)) as double)") for x in ("lat", "lon"))
    usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    row, column = F.floor(F.col("idx") / COLUMNS).cast("int"), (F.col("idx") % COLUMNS).cast("int")
    placed = sampled.withColumn("slot_row", row).withColumn("slot_col", column)
    return placed.withColumn("x", column * THUMB_WIDTH).withColumn("y", row * THUMB_HEIGHT).where(usable)


def collage_size(n: int) -> tuple[int, int]:
    """Width and height for n slots."""
    return COLUMNS * THUMB_WIDTH, -(-n // COLUMNS) * THUMB_HEIGHT


#: 3 x 5 signs of the label, a row of bits each.
GLYPHS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7),
    "7": (7, 1, 1, 1, 1), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), ".": (0, 0, 0, 0, 2), ",": (0, 0, 0, 2, 4), "-": (0, 0, 7, 0, 0), " ": (0, 0, 0, 0, 0),
}
LABEL_HEIGHT, ZOOM = 22, 2


def fitted(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (rows, columns, red green blue) in the middle of black, scaled down if it is larger."""
    scale = min(1.0, width / pixels.shape[1], height / pixels.shape[0])
    w, h = max(1, round(pixels.shape[1] * scale)), max(1, round(pixels.shape[0] * scale))
    rows = np.minimum(((np.arange(h) + 0.5) / scale).astype(int), pixels.shape[0] - 1)
    columns = np.minimum(((np.arange(w) + 0.5) / scale).astype(int), pixels.shape[1] - 1)
    out = np.zeros((height, width, 3), dtype=np.uint8)
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = pixels[rows[:, None], columns]
    return out


def label(text: str, width: int) -> np.ndarray:
    """A black strip with the signs of a place in white."""
    strip = np.zeros((LABEL_HEIGHT, width, 3), dtype=np.uint8)
    for k, sign in enumerate(text[: (width - 8) // (4 * ZOOM)]):
        bits = np.array([[row >> 2 & 1, row >> 1 & 1, row & 1] for row in GLYPHS[sign]], dtype=np.uint8)
        ink = np.kron(bits, np.ones((ZOOM, ZOOM), dtype=np.uint8)).astype(bool)
        strip[5 : 5 + ink.shape[0], 4 + 4 * ZOOM * k : 4 + 4 * ZOOM * k + ink.shape[1]][ink] = 255
    return strip


def png(pixels: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)], axis=1)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _decoded(row: Row) -> np.ndarray | None:
    """Red, green and blue of a row of Spark's image source, which has blue first."""
    if row.height < 0:
        return None
    pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
    return np.repeat(pixels, 3, axis=2) if row.nChannels == 1 else pixels[:, :, 2::-1]


def collage(placed: DataFrame, n: int) -> np.ndarray:
    """The thumbnails of ``placed`` (x, y, image_path, lat, lon) with their places; n slots in all.

    Images are decoded by Spark, a few at a time on the driver, which holds the
    canvas.  Broken or missing ones leave their slot blank.
    """
    width, height = collage_size(n)
    canvas = np.full((height, width, 3), 255, dtype=np.uint8)
    rows, spark = placed.select("x", "y", "image_path", "lat", "lon").collect(), placed.sparkSession  # n rows at most
    for row in rows:
        if not exists(spark, row.image_path):
            continue
        found = spark.read.format("image").option("dropInvalid", "false").load(row.image_path).select("image.*").first()
        pixels = _decoded(found) if found else None
        if pixels is None:
            continue
        slot = canvas[row.y : row.y + THUMB_HEIGHT, row.x : row.x + THUMB_WIDTH]
        slot[:] = fitted(pixels, THUMB_WIDTH, THUMB_HEIGHT)
        slot[-LABEL_HEIGHT:] = label(f"{float(row.lat):.4f}, {float(row.lon):.4f}", THUMB_WIDTH)
    return canvas


def render(placed: DataFrame, n: int, out: str) -> None:
    """Draws the collage and writes it as a PNG file."""
    with writing(placed.sparkSession, out) as write:
        write(png(collage(placed, n)))
