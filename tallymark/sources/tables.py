"""Reads the tables of one data directory."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Return the table stored as parquet at ``{data_dir}/{name}.parquet``.

    The path may be one file or a directory of files, on any file system Spark reads.
    """
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
