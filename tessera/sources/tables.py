"""Parquet table access by name."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data set in ``sf_dir``; a single file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
