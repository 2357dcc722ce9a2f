"""Readers: stored tables, delimited text, JSON, row containers, directories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.schema import narrow


def scan(spark: SparkSession, path: str, schema: T.StructType, columns: Iterable[str] | None = None) -> DataFrame:
    """A stored table with only the named leaves, at any depth."""
    return spark.read.schema(narrow(schema, columns) if columns is not None else schema).parquet(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", trailing: bool = True) -> DataFrame:
    """Text lines split by position and cast by the schema. trailing: each line ends with a separator. Booleans are
    parsed; values that don't fit are null."""
    read = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), *([T.StructField("__end", T.StringType())] if trailing else [])])
    return spark.read.schema(read).option("sep", sep).option("mode", "PERMISSIVE").option("quote", "").csv(path).select(*schema.fieldNames())


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def decode_json(c: Column, schema: T.StructType | str) -> Column:
    return F.from_json(c, schema)


def files(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """All files below a folder, with the path of the file and the row's place in it."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def row_container(spark: SparkSession, path: str) -> DataFrame:
    """Row container files, where the session has Spark's avro package."""
    return spark.read.format("avro").load(path)
