"""Lineage cuts that survive the loss of an executor."""

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without its history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def step(df: DataFrame) -> DataFrame:
    """:func:`cut`, then :func:`release`: what planning and running ``df`` took of the driver's memory is given back before the next step."""
    out = cut(df)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps, which it does after a collection of garbage.

    With ``spark.tessera.release`` set to false nothing is done: on a driver with a large heap each collection is a
    pause, and Spark's own periodic one may do.
    """
    if spark.conf.get("spark.tessera.release", "true").lower() == "false":
        return
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession, at_least: int = 1) -> int:
    """Partition count for explicit repartitions: the session's shuffle width, not less than two waves of its cores."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, width, 2 * spark.sparkContext.defaultParallelism)
