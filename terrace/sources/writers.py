"""Writers: codecs, files by row count, sorted files, key partitions, translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = {"null": "none", "deflate": "gzip", "snappy": "snappy", "zstd": "zstd"}


def codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"no such codec: {name}; there are {sorted(CODECS)}")
    return CODECS[name]


def write(df: DataFrame, path: str, compression: str = "snappy", rows_per_file: int = 0, keys: list[str] | None = None, mode: str = "errorifexists") -> None:
    """keys: rows are sorted by them within each file. rows_per_file: a new file after so many rows."""
    df = df.sortWithinPartitions(*keys) if keys else df
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", codec(compression)).parquet(path)


def partitioned(df: DataFrame, path: str, key: str, degree: int, sort: list[str] | None = None) -> None:
    """One folder for each of ``degree`` key partitions: a later read can take one partition alone."""
    df = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(degree)).cast("int")).repartition(degree, "part")
    (df.sortWithinPartitions("part", *sort) if sort else df).write.partitionBy("part").parquet(path)


def merge_files(spark: SparkSession, paths: list[str], out: str, degree: int, keys: list[str] | None = None) -> None:
    """Files of one schema into ``degree`` new ones: concatenated, or in the order of keys over all files."""
    df = spark.read.parquet(*paths)
    (df.repartitionByRange(degree, *keys).sortWithinPartitions(*keys) if keys else df.repartition(degree)).write.parquet(out)


def translate(df: DataFrame, path: str, form: str, **options: str) -> None:
    """Rewrites a table as parquet, orc, json or avro (with Spark's avro package)."""
    df.write.format(form).options(**options).save(path)


def encode_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
