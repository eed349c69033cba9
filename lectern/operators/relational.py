"""Relational building blocks: visibility, paging, latest rows, nesting, trends."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    """Conjunction of any number of conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_contains(columns: list[str], text: str) -> Column:
    """Case-insensitive substring search over several columns; an empty search matches every row."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in columns])


def one_of(column: str, chosen: list) -> Column:
    """Multi-select facet: nothing chosen means everything."""
    return F.col(column).isin(chosen) if chosen else F.lit(True)


def visible(role: str, owner: Column, team: Column, actor: int, actor_team: int | None) -> Column:
    """Which rows an actor sees: a super admin all, an admin those of the team, a user the own ones; an admin without a team, or any other role, none."""
    if role == "SUPER_ADMIN":
        return F.lit(True)
    if role == "ADMIN" and actor_team is not None:
        return team == actor_team
    if role == "USER":
        return owner == actor
    return F.lit(False)


def last_n(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in the order given, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def latest(df: DataFrame, key: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` of the row with the largest `by` of each key, combined before the shuffle."""
    best = F.max_by(F.struct(*keep), F.struct(*by))
    return df.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order; page numbers begin at 1 and sizes lie between 1 and 200."""
    number, size = max(1, number), min(200, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_match(text: Column, classes: list[tuple[str, list[str]]], other: str) -> Column:
    """The first class one of whose keywords the text contains."""
    out = F.lit(other)
    for name, words in reversed(classes):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words]), name).otherwise(out)
    return out


def day_series(events: DataFrame, ts: str, now: str, days: int, measures: dict[str, Column]) -> DataFrame:
    """Counts by rolling 24-hour age before `now`, zero-filled: (age, one column per measure)."""
    end = F.lit(now).cast("timestamp_ntz")
    age = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000).cast("long")
    counted = events.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < days)).groupBy("age").agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
    spine = events.sparkSession.range(days).select(F.col("id").alias("age"))
    return spine.join(F.broadcast(counted), "age", "left").select("age", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def kept(df: DataFrame) -> DataFrame:
    """df written once and read from then on: a reliable checkpoint in the folder that spark.checkpoint.dir names. Where none is named, local mode takes a temporary one, and a cluster an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the cluster has cores at least, for work that is heavy by row: a small file is one partition, however long its rows take. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def dealt_over(spark: SparkSession) -> int:
    """Over how many partitions rows are dealt whose work has little to do with their bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
