"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def names(spark: SparkSession, directory: str) -> list[str]:
    """The tables of a directory, by its listing (names only)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n[: -len(".parquet")] for f in found if (n := f.getPath().getName()).endswith(".parquet"))


def columns(spark: SparkSession, directory: str, table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns, from its footer."""
    return [(f.name, f.dataType.simpleString()) for f in load(spark, directory, table).schema.fields]
