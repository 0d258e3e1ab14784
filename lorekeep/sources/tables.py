"""Readers for the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Parquet table `name` under `base`, pruned to `columns` when any are given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df
