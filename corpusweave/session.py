"""Session settings the engine is designed for; on a cluster, sizes come from the cluster's own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "corpusweave") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions).config("spark.ui.showConsoleProgress", "false")
    return b.config(map=SETTINGS).getOrCreate()
