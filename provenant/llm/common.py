"""Shared pieces of the training-data operators: scratch tables, row keys, exact distributed ranks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words, but for the space.
SPACES = "\t\n\x0b\f\r"
#: Bytes that one Arrow batch of texts aims at, so that a worker's memory follows this and the longest text, not the partition.
BATCH_BYTES = 8 << 20
#: Drops a statement's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Texts vary from nothing to megabytes: they go to Python by bytes, not by rows. One value for all operators, so that it
    doesn't matter which of them was built last when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a folder of this machine stands in if Spark runs on it
    alone (tests); on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="provenant-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a scratch table below the application's own folder. What isn't dropped before, because a lazy result still
    reads it, goes with that folder when the driver ends."""
    run = f"{scratch_dir(spark)}/provenant-{spark.sparkContext.applicationId}"
    where, store = _folder(spark, run)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{run}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements that run inside drop their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage of ``df`` with a table in the shared folder: a lost executor costs no recomputation, and the shuffle files
    that led to it go at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing will read again."""
    where, store = _folder(spark, path)
    store.delete(where, True)


def signed(x: int) -> int:
    """An unsigned 64-bit number as a long."""
    return x - (1 << 64) if x >> 63 else x


def text_key(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id apart by their texts (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def uniform_buckets(n_rows: int, least: int = 200) -> int:
    """How many buckets of a uniform hash to cut ``n_rows`` into: about as many as each has rows, once these are ``least``."""
    return max(1, -(-n_rows // max(least, math.isqrt(n_rows))))


def running_sum(
    df: DataFrame, key: str, order: list[str], value: str, out: str, buckets: int, seed: int = 7
) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``key``, in the order of a seeded hash of ``order``.

    No key is summed in one task: rows are dealt by (key, bucket of the hash), each bucket has its
    own running sum, and the buckets' totals, at most ``buckets`` rows for each key, give its start.
    The order is the same in every run. Rows equal in all of ``order`` are interchangeable.
    ``key`` may be null. Adds ``out`` (long).
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    mixed = df.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftright("_h", 16), F.lit(buckets)).cast("int"))
    totals = mixed.groupBy(key, "_b").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(key).alias("_k"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s")
    )
    joined = mixed.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_sb")))
    inside = Window.partitionBy(key, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(
        out, (F.col("_s") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")
    ).drop("_h", "_b", "_k", "_sb", "_s")
