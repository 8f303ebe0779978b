"""Raw stores: JSON arrays with their order, and JSON lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PARSED
from ..tables import exists, writing


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """ord, json: the elements of a JSON array file, each as its own text.

    A missing file has none; a file that is no array is an error.  Key order and
    the spelling of numbers stay as they are in the file.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "ord long, json string")
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    return whole.select(F.posexplode(items).alias("ord", "json")).select(F.col("ord").cast("long").alias("ord"), "json")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of an array file in its order, with their raw text.

    Places and headings may be numbers or texts of numbers; any other text is an
    error that tells the record.
    """
    numbers = ("lat", "lon", "heading")
    names = [f.name for f in PARSED.fields if f.name != "ord"] + ["heading", "url", "thumb_path", "license", "attribution"]
    fields = F.from_json("json", ", ".join(f"{x} string" for x in names)).alias("r")

    def number(name: str) -> Column:
        text = F.trim(F.col(f"r.{name}"))
        value = text.try_cast("double")
        wrong = F.raise_error(F.concat(F.lit(f"{path}: record "), F.col("ord"), F.lit(f" has a {name} that is no number: "), text)).cast("double")
        return F.when(text.isNotNull() & value.isNull(), wrong).otherwise(value).alias(name)

    items = read_items(spark, path).select("ord", fields, F.col("json").alias("raw_json"))
    return items.select("ord", *(number(x) if x in numbers else F.col(f"r.{x}") for x in names), "raw_json")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, one file a task, in place of what is there."""
    rows.write.mode("overwrite").json(path)


def write_json(path: str | Path, payload: object) -> None:
    """One small JSON file on the driver: parents made, two spaces, Unicode kept."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")


def write_array(spark: SparkSession, path: str, payload: object) -> None:
    """As :func:`write_json`, but through the file system that owns the path."""
    with writing(spark, path) as out:
        out(json.dumps(payload, ensure_ascii=False).encode())


def read_json(path: str | Path, default: object) -> object:
    """A small JSON file on the driver; the default where it is missing."""
    target = Path(path)
    return json.loads(target.read_text(encoding="utf-8")) if target.exists() else default
