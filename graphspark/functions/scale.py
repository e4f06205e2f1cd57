"""Helpers for jobs of any size: cutting lineage, checked broadcasts, and sums and numbers over a whole order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared folder, so that lost executors cost no earlier work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_enough(rows: int, row_bytes: int = 100, limit_bytes: int = 32 << 20) -> bool:
    """Whether a counted table may be broadcast; callers join by shuffling where it may not. A row of a few numbers takes about 100 bytes in a hash table."""
    return rows * row_bytes <= limit_bytes


def broadcast_if_small(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """``df``, which has been written, with a hint to broadcast it where its counted rows allow that."""
    return F.broadcast(df) if small_enough(df.count(), row_bytes) else df


#: Rows of a range, and the fewest ranges of an order.
RANGE_ROWS, LEAST_RANGES = 250_000, 8


def ranges_for(df: DataFrame) -> int:
    """How many ranges an order over ``df`` is cut into: from its counted rows, so that a range stays as small at any size."""
    return max(LEAST_RANGES, -(-df.count() // RANGE_ROWS))


#: Rows of a task of a join or a distinct, and the fewest tasks.
TASK_ROWS, LEAST_TASKS = 500_000, 8


def tasks_for(*tables: DataFrame) -> int:
    """To how many tasks tables are dealt by key: from their counted rows, so that a task's memory is the same at any size. Parts of a given number are not put together again by adaptive execution, which looks at compressed bytes alone."""
    return max(LEAST_TASKS, -(-sum(t.count() for t in tables) // TASK_ROWS))


def running(df: DataFrame, order: list[Column], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before a row in the order, which must be total.

    Rows are sorted in ranges; a range adds the sums of those before it (``parts`` rows, by default from the count), so that no task holds all of them.
    """
    ranges = cut(df.withColumn("__value", value).repartitionByRange(parts or ranges_for(df), *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("__part").agg(F.sum("__value").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.join(F.broadcast(sums), "__part").withColumn(out, F.col("__before") + F.coalesce(F.sum("__value").over(within), F.lit(0))).drop("__value", "__part", "__before")


def running_within(df: DataFrame, key: str, order: list[str | Column], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same key before a row, in an order that must be total within a key.

    The rows are cut into ranges of (key, order), wherever keys end; a range of a key begins at the sum that the key has in the ranges
    before (a row a key and range). A key with all rows is summed by as many tasks as there are ranges. Null is a key as any other.
    """
    ranges = cut(df.withColumn("__value", value).repartitionByRange(parts or ranges_for(df), key, *order).withColumn("__own", F.spark_partition_id()))
    sums = ranges.groupBy(F.col("__own").alias("__part"), F.col(key).alias("__key")).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select("__part", "__key", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("__own", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    joined = summed.join(broadcast_if_small(starts), (F.col("__own") == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn(out, F.col("__before") + F.col("__within")).drop("__value", "__own", "__part", "__key", "__before", "__within")


def numbered_within(df: DataFrame, key: str, order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the number (from 0) of a row within its key, in the order, which must be total within a key."""
    return running_within(df, key, order, F.lit(1).cast("long"), out, parts)
