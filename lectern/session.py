"""The local session that tests and the bench use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with UTC time and adaptive execution. Only settings that a local run needs are fixed here."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("lectern")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory).config("spark.sql.warehouse.dir", "/tmp/lectern-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
