"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt over all cores, some parts for each: a file's row group is one task's work, however much each row takes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
