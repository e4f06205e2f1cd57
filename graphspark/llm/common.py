"""What the operators of this subpackage share: reading, cutting lineage, and small text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small, cut, running, running_within, shared_dir, small_enough

__all__ = ["broadcast_if_small", "crc_mod", "cut", "finite_vectors", "fraction_of", "keep", "map_batches", "read_table", "running", "running_within", "shared_dir", "small_batches", "small_enough", "sum_parts"]

#: A word of the corpus contracts: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark hand texts to Python in batches of ``BATCH_BYTES``: the default of 64 MB is held several times over, in each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def map_batches(df: DataFrame, columns: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns alone, so that no other column leaves the JVM."""
    return small_batches(df).select(*columns).mapInArrow(run, schema)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def fraction_of(*columns: Column) -> Column:
    """A reproducible pseudorandom number in [0, 1) from the values of the columns."""
    return F.pmod(F.xxhash64(F.lit(0x5EED), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


_kept: list = []


def keep(key, make: Callable):
    """The one model that a Python worker keeps between batches; another key replaces it."""
    if not _kept or _kept[0] != key:
        _kept.clear()
        _kept[:] = [key, make()]
    return _kept[1]


def finite_vectors(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector is of the usual length (the most frequent; of equally frequent ones the longest) and holds finite numbers alone, and that length."""
    no = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~F.exists(vector, no))
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).select("m.d").first()
    dims = sizes.d or 0
    return rows.where(F.size(vector) == dims), dims


def sum_parts(blocks: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of an array of numbers that ``part`` makes of all batches of a task: its places are summed by Spark, and only the sums are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found.astype(float))], ["k", "v"])

    sums = {r.k: r.v for r in blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return np.array([sums[k] for k in range(len(sums))])
