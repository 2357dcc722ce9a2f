"""Positional reads of stored tables and cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_slice(spark: SparkSession, path: str, start: int, n: int = 1, columns: list[str] | None = None) -> DataFrame:
    """n rows of a stored table from position ``start``, counted over its files in the order of their paths. Rows are counted
    by file without reading a column; files outside the slice give no rows, and only the named columns are filled."""
    df = spark.read.parquet(path)
    at, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    counts = df.select(file.alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
    before = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    offsets = counts.select("__file", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")).where((F.col("__offset") < start + n) & (F.col("__offset") + F.col("__n") > start))
    out = df.select(*(columns or df.columns), at.alias("__at"), file.alias("__file")).join(offsets, "__file")
    return out.select(*(columns or df.columns), (F.col("__at") + F.col("__offset")).alias("row_index")).where((F.col("row_index") >= start) & (F.col("row_index") < start + n))


def seek(df: DataFrame, column: str, value) -> DataFrame:
    """Rows from a value on; row groups below it are skipped by their statistics."""
    return df.where(F.col(column) >= F.lit(value))


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, from the schema alone."""
    return df.dtypes
