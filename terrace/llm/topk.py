"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are packed, where they lie, into buckets of similar length: each group of up to ``packed`` rows is sorted by length
and cut into matrices of ``bucket`` rows. Buckets are dealt to groups, where they stay; queries are packed into blocks, which
go to all groups, since only they and their k best of a group move. A block meets a group's buckets, longest first, and keeps
its k best scores so far; theta is the k-th of them. For a bucket with longest length m, a query of length |q| has
the local cosine threshold t = theta / (|q| m):

t > 1        no vector of the bucket can qualify: skipped.
t high       coordinate pruning: with q' and p' the directions, cos >= t bounds p' in q's largest coordinates f by
             t q'_f -+ sqrt((1 - t^2)(1 - q'_f^2)); only vectors inside all bounds are verified.
else         length pruning: only vectors with |p| >= theta / |q| are verified.

Verification is the inner product of the original vectors. Memory holds a group's buckets, one block and k scores for each of
its queries.

Nulls and odd values: vectors null, empty or with null or non-finite components, and rows with a null id, take no part.
Shorter vectors are padded with zeros. Ties go to the smaller id. Rows that share an id are candidates each; a query
doesn't see rows of its own id. Fewer than k candidates give fewer rows; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import finite_vector

BLOCKS = "block long, n int, width int, longest double, ids binary, vectors binary"


def packed_blocks(rows: DataFrame, bucket: int, packed: int, by_length: bool = True) -> DataFrame:
    """rows (id, v array<double>) as matrices of up to ``bucket`` rows, by falling length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number, ids, vectors = TaskContext.get().partitionId() << 32, 0, [], []

        def blocks() -> Iterator[dict]:
            nonlocal number
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            i = np.array(ids, "<i8")
            lengths = np.sqrt((m * m).sum(1))
            order = np.lexsort((i, -lengths)) if by_length else np.arange(len(i))
            for at in range(0, len(order), bucket):
                o = order[at : at + bucket]
                yield {"block": base + number, "n": len(o), "width": width, "longest": float(lengths[o].max()), "ids": i[o].tobytes(), "vectors": m[o].tobytes()}
                number += 1

        for batch in batches:
            for at in range(0, len(batch), packed):
                part = batch.iloc[at : at + packed]
                ids.extend(part["id"])
                vectors.extend(part["v"])
                if len(ids) >= packed:
                    yield pd.DataFrame(list(blocks()))
                    ids.clear()
                    vectors.clear()
        if ids:
            yield pd.DataFrame(list(blocks()))

    return rows.mapInPandas(run, BLOCKS)


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.vectors).reshape(row.n, row.width)


def streamed(held: DataFrame, asked: DataFrame, groups: int, run: Callable, schema: str, order: str) -> DataFrame:
    """held: rows with a group from 0 on, which stay together; asked: rows that go to all groups. run gets the rows of a group
    one after the other, tag 0: the held ones by falling ``order``, then tag 1: the asked ones."""
    everywhere = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("tag"))
    rows = held.withColumn("tag", F.lit(0)).unionByName(everywhere, allowMissingColumns=True)
    return rows.repartition(2 * groups, "group").sortWithinPartitions("group", "tag", F.desc(order)).mapInPandas(run, schema)


def best(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def smaller(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def bucket_scores(q: np.ndarray, own: int, q_len: float, m: np.ndarray, ids: np.ndarray, lengths: np.ndarray, theta: float, coordinate_from: float, focus: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the vectors of one bucket that may reach theta."""
    if q_len == 0 or theta <= 0:
        places = np.arange(len(ids)) if theta <= 0 or not np.isfinite(theta) else np.array([], int)
    else:
        t = theta / (q_len * lengths[0]) if lengths[0] else np.inf
        t -= 1e-9
        places = np.arange(np.searchsorted(-lengths, -(theta / q_len) * (1 - 1e-9), "right"))
        if t > 1:
            places = places[:0]
        elif t >= coordinate_from and len(places):
            d = q / q_len
            ok = np.ones(len(places), bool)
            for f in np.argsort(-np.abs(d))[:focus]:
                c = m[places, f] / lengths[places]
                spread = np.sqrt((1 - t * t) * max(0.0, 1 - d[f] * d[f])) + 1e-9
                low, high = t * d[f] - spread, t * d[f] + spread
                ok &= ((c >= low) | (-d[f] >= t)) & ((c <= high) | (d[f] >= t))
            places = places[ok]
    places = places[ids[places] != own]
    return ids[places], m[places] @ q


def top_k(vectors: DataFrame, queries: DataFrame, k: int, bucket: int = 1024, block: int = 512, buckets: int = 8, coordinate_from: float = 0.5, focus: int = 3) -> DataFrame:
    """vectors, queries: (id long, v array of integers as double). Products stay exact below 2^53. About ``buckets`` buckets are
    one task's, so the number of tasks grows with the data."""
    groups = max(1, -(-vectors.count() // (bucket * buckets)))
    held = packed_blocks(vectors, bucket, 8 * bucket).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, of_group = None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.group != group:
                    group, of_group = row.group, []
                ids, m = unpack(row)
                if row.tag == 0:
                    of_group.append((ids, m, np.sqrt((m * m).sum(1))))
                    continue
                state = [(np.array([], "<i8"), np.array([]))] * len(ids)
                q_len = np.sqrt((m * m).sum(1))
                for b_ids, b, lengths in of_group:
                    width = max(b.shape[1], m.shape[1])
                    vs, qs = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (b, m))
                    for j, (got, scores) in enumerate(state):
                        theta = scores[-1] if len(scores) == k else -np.inf
                        new, products = bucket_scores(qs[j], ids[j], q_len[j], vs, b_ids, lengths, theta, coordinate_from, focus)
                        if len(new):
                            i, s = np.concatenate([got, new]), np.concatenate([scores, products])
                            at = smaller(s, i, k)
                            state[j] = (i[at], s[at])
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(i) for i, _ in state]), "vec_id": np.concatenate([i for i, _ in state]), "score": np.concatenate([s for _, s in state])})

    return best(streamed(held, packed_blocks(queries, block, block, by_length=False), groups, run, "query_id long, vec_id long, score double", "longest"), k)


def scaled(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): valid vectors, each component x as floor(scale * x)."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & finite_vector(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def as_double(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))
