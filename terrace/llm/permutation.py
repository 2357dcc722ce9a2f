"""Approximate nearest neighbours by largest inner product, with a permutation index.

Vectors of different lengths get one more component, sqrt(L^2 - |x|^2) with L the greatest length, so that the largest
inner product is the nearest direction; queries get 0 there. A vector is represented by its ``prefix`` nearest pivots in
order. Vectors are dealt by hash to blocks of about ``block``, which keep one inverted file for each pivot: (vector, place
of the pivot). A query reads the files of its own nearest pivots and ranks vectors by the footrule distance of the
prefixes, a pivot that is missing counting as place ``prefix``; the nearest ``share`` of each block, and as many as a result
may need, are reranked by their exact inner product, at every size alike. Every vector is indexed.

Blocks stay where they are built. Queries go to all of them in groups of about ``query_block``, and k results a query and
block come back.

Pivots are a bounded sample, ``pivots`` distinct vectors with the smallest hashes. Equal vectors are indexed once with
their k + 1 smallest ids, which is all that a result of k can hold, so copies can't crowd out others.

Nulls and odd values: vectors null, empty, zero or with null or non-finite components, and rows with a null id, take no
part. Shorter vectors are padded with zeros. Ties go to the smaller id. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.shared import finite_vector
from terrace.llm.topk import as_double, best, smaller, streamed

INDEX = "group int, n int, ids binary, counts binary, vectors binary, starts binary, members binary, places binary"
QUERIES = "part long, q_ids binary, q_vectors binary"


def valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles."""
    v = vectors.where(F.col(id_col).isNotNull() & finite_vector(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), as_double(F.col(vector)).alias("v"))
    return v.where(F.exists("v", lambda x: x != 0))


def distinct_vectors(v: DataFrame, k: int) -> DataFrame:
    """(v, ids): equal vectors once, with their k smallest ids. Each task passes on k rows of a vector at most."""
    w = W.partitionBy("h", "v").orderBy("id")
    top = v.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids")


def permutations(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first. m, pivots: unit rows."""
    near = m @ pivots.T
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(m), 1))
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def lifted(m: np.ndarray, longest: float) -> np.ndarray:
    """Unit rows of one more component, for which nearness is the inner product."""
    more = np.sqrt(np.maximum(0.0, longest * longest - (m * m).sum(1)))
    return np.hstack([m, more[:, None]]) / longest


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    m = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        m[i, : len(x)] = x
    return m


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = 256, prefix: int = 64, share: float = 0.2, block: int = 8192, query_block: int = 512, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest found, never a row of its own id."""
    v, qv = valid(vectors, id_col, vector), valid(queries, id_col, vector).dropDuplicates(["id", "v"])
    d = distinct_vectors(v, k + 1)
    bounds = v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("l"), F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    asked = qv.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    if bounds.l is None or not asked.n:
        return v.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    longest, width = float(np.sqrt(bounds.l)), max(bounds.w, asked.w)
    blocks, parts = math.ceil(bounds.n / block), math.ceil(asked.n / query_block)
    p = matrix([r.v for r in d.select("v").orderBy(F.xxhash64(F.lit(17), "v"), "v").limit(pivots).collect()], width)
    p = lifted(p, longest)
    prefix = min(prefix, len(p))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = matrix(rows["v"], width)
        flat = permutations(lifted(m, longest), p, prefix).ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[order], np.arange(len(p) + 1))
        return pd.DataFrame([{"group": key[0], "n": len(m), "ids": np.concatenate(list(rows["ids"])).astype("<i8").tobytes(), "counts": rows["ids"].map(len).to_numpy("<i4").tobytes(), "vectors": m.tobytes(), "starts": starts.astype("<i4").tobytes(), "members": (order // prefix).astype("<u4" if len(m) > 65536 else "<u2").tobytes(), "places": (order % prefix).astype("<i2").tobytes()}])

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": key[0], "q_ids": rows["id"].to_numpy("<i8").tobytes(), "q_vectors": matrix(rows["v"], width).tobytes()}])

    index = d.withColumn("group", F.pmod(F.xxhash64(F.lit(29), "v"), F.lit(blocks)).cast("int")).groupBy("group").applyInPandas(build, INDEX)
    q = qv.withColumn("part", F.pmod(F.xxhash64(F.lit(31), "id", "v"), F.lit(parts)).cast("long")).groupBy("part").applyInPandas(gather, QUERIES)

    def nearest(row, qm: np.ndarray, own: np.ndarray, perm: np.ndarray, state: list) -> None:
        """Puts what a block has into the results of a group's queries."""
        rows = int(row.n)
        m = np.frombuffer(row.vectors).reshape(rows, width)
        counts = np.frombuffer(row.counts, "<i4")
        ids, first = np.frombuffer(row.ids, "<i8"), np.concatenate([[0], np.cumsum(counts)])
        starts = np.frombuffer(row.starts, "<i4")
        members = np.frombuffer(row.members, "<u4" if rows > 65536 else "<u2").astype(np.intp)
        left = (prefix - np.frombuffer(row.places, "<i2")).astype(float)
        keep = min(rows, max(k + 1, math.ceil(share * rows)))
        for j in range(len(own)):
            at = np.arange(rows)
            if keep < row.n:
                # Footrule of prefixes, from its greatest value down: a pivot at places r and s of both takes away
                # (prefix - r) + (prefix - s) - |r - s|, which is twice the smaller of the two.
                spans = [slice(starts[x], starts[x + 1]) for x in perm[j]]
                mine = np.repeat(prefix - np.arange(prefix, dtype=float), [x.stop - x.start for x in spans])
                near = np.bincount(np.concatenate([members[x] for x in spans]), np.minimum(mine, np.concatenate([left[x] for x in spans])), rows)
                at = np.argpartition(-near, keep - 1)[:keep]
            n = counts[at]
            i = ids[np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            s = np.repeat((m[at] * qm[j]).sum(1), n)
            other = i != own[j]
            i, s = np.concatenate([state[j][0], i[other]]), np.concatenate([state[j][1], s[other]])
            top = smaller(s, i, k)
            state[j] = i[top], s[top]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples():
                if row.tag == 0:
                    held = row
                    continue
                if held is None or held.group != row.group:  # a group without vectors
                    continue
                own = np.frombuffer(row.q_ids, "<i8")
                qm = np.frombuffer(row.q_vectors).reshape(len(own), width)
                state = [(np.array([], "<i8"), np.array([]))] * len(own)
                units = qm / np.sqrt((qm * qm).sum(1))[:, None]
                nearest(held, qm, own, permutations(np.hstack([units, np.zeros((len(own), 1))]), p, prefix), state)
                yield pd.DataFrame({"query_id": np.repeat(own, [len(i) for i, _ in state]), "vec_id": np.concatenate([i for i, _ in state]), "score": np.concatenate([s for _, s in state])})

    return best(streamed(index, q, blocks, run, "query_id long, vec_id long, score double", "n"), k)
