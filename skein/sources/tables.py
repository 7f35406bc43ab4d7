"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table as it is; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
