"""A training corpus from ``documents``: toxic texts go, repeated lines go, one text of each near-duplicate class stays,
secrets are marked, and what is left is packed into token windows.

Each stage works on all that the one before it kept, and gives the columns of documents, the last one pieces. run() writes
each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import lines, near_dup, packing, queries, secret_scan, toxicity
from terrace.llm.shared import checkpoint_dir, cut, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model rejects go, whatever their id."""
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), extra=["text", "lang", "source", "n_chars"])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; all rows stay, those with a null id whole."""
    out = lines.dedup_lines(docs, extra=["lang", "source"])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the smallest id of each class stays, of rows that share it the greatest (null texts last); empty texts are
    no copies of each other; rows with a null id stay."""
    found = near_dup.classes(docs, empty_equal=False)
    copies = cut(found.where("doc_id <> class_id").select("doc_id").distinct())
    kept = docs.select(*COLUMNS).join(near_dup.few(copies), "doc_id", "left_anti")
    again = near_dup.few(cut(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")))
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    out = secret_scan.scan(docs, extra=["lang", "source"])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("secret_scan", mark_secrets), ("packing", pack_windows)]
#: No stage but line dedup can be put in SQL; tests hold all five against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. A stage's files go when the next one has read them; the last one's stay."""
    root = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
