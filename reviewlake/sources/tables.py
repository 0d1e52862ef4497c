"""Reading tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``directory``; columns are pruned and filters pushed down by the reader."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
