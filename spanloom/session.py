"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("spanloom")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
