"""Sessions for local use; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("geoloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def healthy(spark: SparkSession) -> tuple[int, dict[str, str]]:
    """200 and ok if the engine answers a query, else 503 and the kind of failure."""
    try:
        spark.sql("SELECT 1").collect()
    except Exception as error:
        return 503, {"status": "unavailable", "detail": type(error).__name__}
    return 200, {"status": "ok"}
