"""Reading tables and semi-structured sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def webhook_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of any shape, one variant column `payload` for each line; lines that aren't JSON become null rather than failing."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("payload"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its name, order within its group from the number in the name, and content."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.expr(r"try_cast(regexp_extract(element_at(split(path, '/'), -1), '(\\d+)', 1) as int)").alias("sequence"), F.col("value").alias("content"))
