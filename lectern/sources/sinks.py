"""Writing results: CSV export, JSON lines, ordered text, and rewrites of tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `changes` replace rows of `stored` with their key and are added otherwise; columns null in a change keep the stored value."""
    rest = [c for c in stored.columns if c not in key]
    s, c = stored.alias("s"), changes.alias("c")
    joined = s.join(c, on=[F.col(f"s.{k}") == F.col(f"c.{k}") for k in key], how="full_outer")
    return joined.select(*[F.coalesce(f"c.{x}", f"s.{x}").alias(x) for x in [*key, *rest]]).select(stored.columns)


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't stored, one of each key."""
    return new.dropDuplicates(key).join(stored.select(key), key, "left_anti")
