"""Line dedup: lines are normalised to keys, hashed and exploded; documents are counted by hash; lines over the threshold
go, except in the largest document id that holds them; the rest is joined again in order.

Counting runs in two steps, by (hash, document) and then by hash with partial counts, so a line that most documents share
costs each task one row. The join that finds each document's lines to drop deals out the rows of the most frequent lines
(``join_hot``). Keys are two independent 64-bit hashes.

Nulls: a null text is one empty line. Rows with a null id take no part and stay whole. Rows that share an id are one
document when documents are counted; each of them loses its lines. Short keys and an empty table change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import join_hot

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays), and the columns named in ``extra``, one row for each row of docs."""
    passed = [f"__{c}" for c in extra or []]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"__{c}") for c in extra or []))
    long_keys = F.filter(F.transform(_lines("text"), line_key), lambda k: F.char_length(k) >= min_chars)
    pairs = d.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(F.transform(long_keys, _hash))).alias("h"))
    pairs = pairs.select("doc_id", "h.a", "h.b")
    hot = pairs.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("a", "b", "keeper", "n")
    drops = join_hot(pairs, hot, ["a", "b"], "n", ["doc_id"]).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drops"))
    j = d.join(drops, "doc_id", "left").select("doc_id", _lines("text").alias("lines"), "drops", *passed)

    def stays(line: Column) -> Column:
        k = line_key(line)
        return (F.char_length(k) < min_chars) | ~F.array_contains(F.col("drops"), _hash(k))

    j = j.select("doc_id", *passed, F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept"))
    return j.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"), *(F.col(f"__{c}").alias(c) for c in extra or []))
