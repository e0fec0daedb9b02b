"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters chosen later are pushed to the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
