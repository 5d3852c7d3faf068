"""Checks of size: what may be broadcast, and where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when its measured size is below this bound.
BROADCAST_BYTES = 64 << 20
# A key with at least one in HOT_SHARE of the sampled rows is hot.
HOT_SHARE = 64
SAMPLE_FRACTION = 0.01
# Over how many join keys a hot key is spread.
SALTS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Exact size of the values of a table, counted by Spark."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(16)
                 for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def hot_keys(sampled: DataFrame, on: list[str]) -> list:
    """Keys that hold a large share of a sample: at most ``HOT_SHARE`` rows."""
    total = sampled.count()
    return (sampled.groupBy(*on).agg(F.count("*").alias("n"))
            .where(F.col("n") * HOT_SHARE >= F.lit(max(total, 1))).select(*on).collect())


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                spread_by: list[str] | None = None, max_bytes: int | None = None,
                sampled: DataFrame | None = None) -> DataFrame:
    """Equi-join of a big table with a lookup table.

    A lookup table below the bound is broadcast and the big side does not
    move.  Above it both sides are shuffled.  Keys that are hot in a sample of
    the big side are salted: their rows are spread over ``SALTS`` values and
    only their lookup rows are copied; rows with null keys are spread too.  The
    sample decides about speed only, never about the result; ``sampled`` gives
    a cheaper one.  ``max_bytes=-1`` is for a lookup table known to be too big.
    """
    if max_bytes != -1 and fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    keys = big.sample(SAMPLE_FRACTION, seed=1) if sampled is None else sampled
    hot = F.lit(False)
    for row in hot_keys(keys.select(*on), on):
        same = F.lit(True)
        for k in on:
            same = same & F.col(k).eqNullSafe(F.lit(row[k]))
        hot = hot | same
    no_key = F.lit(False)
    for k in on:
        no_key = no_key | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in (spread_by or big.columns)]), F.lit(SALTS)).cast("int")
    salted = big.withColumn("__salt", F.when(hot | no_key, spread).otherwise(F.lit(0)))
    copies = small.withColumn("__salt", F.explode(
        F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, on + ["__salt"], how).drop("__salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.  Only a
    local session may make its own, which goes when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spanwright-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


_local_folder: str | None = None


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it is; one that isn't there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder.  Its size is
    known from its files; a checkpoint keeps the estimate of its plan, which
    grows with each of many rounds of joins."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
