"""Exact top-k inner-product search by no-random-access aggregation.

Vectors are turned into integers floor(scale * x).  Candidates are dealt
into blocks by id hash, queries into blocks too, and each pair of blocks
is one task.  Inside a task every dimension is a sorted list, read
sequentially to a growing depth, from the top for positive query
components and from the bottom for negative ones.  What has been read
gives each candidate a lower and an upper bound: an unread component lies
between the list's end and the value last read.  A query stops when the
candidates whose upper bound reaches its k-th lower bound are few; their
final scores are then resolved exactly.  Block winners are merged per
query.

Bounded memory: a task holds one block of candidates and one slice of
queries.  A lost executor costs only its block pairs.

Edge cases: vectors that are null or hold null or non-finite components
take no part; vectors of different length are never compared; a row is
known by its id (rows that repeat a query's id are its own); ties go to
the smaller id; fewer than k candidates give fewer rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
#: Queries bounded at once inside a task.
QUERY_SLICE = 256


def _dtype(q: np.ndarray, x: np.ndarray):
    """The cheapest type in which every partial sum is an exact integer."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def nra_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top-k of each query within one block: (query positions, candidate positions, scores)."""
    n = len(ids)
    kind = _dtype(q, x)
    q, x = q.astype(kind), x.astype(kind)
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    few = max(4 * k, n // 64)
    out_q, out_c, out_s = [], [], []
    active, depth = np.arange(len(q)), max(1, n // 4)
    while len(active):
        depth = min(depth, n)
        from_top, from_bottom = lists[n - depth], lists[depth - 1]
        last = depth == n
        best = np.maximum(x, from_top).T, np.minimum(x, from_bottom).T
        worst = np.where(x >= from_top, x, low).T, np.where(x <= from_bottom, x, high).T
        waiting = []
        for at in range(0, len(active), QUERY_SLICE):
            rows = active[at : at + QUERY_SLICE]
            own = ids[None, :] == q_ids[rows, None]
            upper = up[rows] @ best[0] + down[rows] @ best[1]
            lower = np.where(own, -np.inf if kind != np.int64 else np.iinfo(np.int64).min, up[rows] @ worst[0] + down[rows] @ worst[1])
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else lower.min(axis=1)
            alive = (upper >= kth[:, None]) & ~own
            done = np.ones(len(rows), bool) if last else alive.sum(axis=1) <= few
            waiting.append(rows[~done])
            r, c = np.nonzero(alive & done[:, None])
            score = np.einsum("ij,ij->i", q[rows[r]].astype(np.int64), x[c].astype(np.int64))
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k
            out_q.append(rows[r[keep]])
            out_c.append(c[keep])
            out_s.append(score[keep])
        active, depth = np.concatenate(waiting), depth * 2
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_q, out_c, out_s))


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, query_divisor: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Returns query_id long, rank int (from 1), vec_id long, score long."""
    vec = F.col(f"`{vec_col}`")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.filter(vec.isNotNull() & F.col(f"`{id_col}`").isNotNull()).filter(~bad)
    whole = whole.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vec, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"), F.size(vec).alias("dim"))
    is_query = F.col("id") % query_divisor == 0
    n, n_queries = whole.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    candidates = whole.select("id", "v", "dim", deal(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = whole.filter(is_query).select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), deal(query_blocks, 2).alias("qb"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if q.empty or c.empty:
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in columns})
        q_ids, ids = q["id"].to_numpy(), c["id"].to_numpy()
        qs, cs, score = nra_block(q_ids, np.stack(q["v"].to_numpy()), ids, np.stack(c["v"].to_numpy()), k)
        return pd.DataFrame(dict(zip(columns, (q_ids[qs], ids[cs], score), strict=True)))

    key = ["dim", "b", "qb"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
