"""Map files (TopoJSON-like JSON) and the plain-text list of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendlens.operators.maps import country_names


def read_atlas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per JSON document. A map file is a single JSON object, so each
    file is parsed whole by one task; many files spread over many tasks."""
    return spark.read.option("multiLine", True).json(path)


def atlas_country_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct, stripped, sorted country names of the map files at ``path``."""
    return country_names(read_atlas(spark, path))


def write_names(names: DataFrame, path: str, column: str = "name") -> str:
    """One name per line, in ascending order across the part files (the
    sort is a range partitioning, so part i holds names before part i+1)."""
    names.select(column).orderBy(column).write.mode("errorifexists").text(path)
    return path
