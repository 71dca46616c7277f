"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class DataMissingError(FileNotFoundError):
    """A table that a query needs is not in the data directory."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory `sf_dir`; DataMissingError if it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise DataMissingError(f"{sf_dir}/{name}.parquet") from e
        raise
