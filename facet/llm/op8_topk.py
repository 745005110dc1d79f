"""Exact top-k inner products by KD-trees, one per shard.

Vectors are dealt to shards of about shard_rows by a hash, so that equal vectors never gather in one shard. In a shard, a KD-tree splits at the
median of the widest dimension down to leaves of leaf_rows and keeps the tight bounding box of every node. A query goes best-first through the
tree: the bound of a box for a query q is the sum over dimensions of max(q*low, q*high), and a node whose bound lies under the k-th best score
so far is never opened.

The k-th score is propagated: in a first pass each query searches the shard that holds it, and its k-th score there, a lower bound of the final
one, goes with it to all other shards. Queries are sent in blocks of query_rows, so that a task holds one shard and one block of queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, one_thread


VALUES = 4_000_000


class Tree:
    """KD-tree over whole-number vectors x (float64 where all products and sums are exact in it, else Python integers)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int = 64):
        self.x = x
        order = np.arange(len(x))
        lows, highs, kids, spans = [], [], [], []

        def build(a: int, b: int) -> int:
            node = len(lows)
            part = x[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            lows.append(low)
            highs.append(high)
            kids.append(None)
            spans.append((a, b))
            if b - a > leaf_rows and (wide := np.argmax(high - low)) is not None and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(part[:, wide], kind="stable")]
                kids[node] = (build(a, a + mid), build(a + mid, b))
            return node

        build(0, len(x))
        self.order, self.kids, self.spans = order, kids, spans
        self.low, self.high = np.array(lows), np.array(highs)
        self.x, self.ids = x[order], ids[order]

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray | list, block: int = 256):
        """For each query: (scores, ids) of the k best of the shard that reach floors[i] (None: no floor), without rows named own[i]; best
        first, ties to the smaller id."""
        for start in range(0, len(queries), block):
            part = queries[start : start + block]
            zero = part * 0
            bounds = np.maximum(part, zero) @ self.high.T + np.minimum(part, zero) @ self.low.T
            for i, q in enumerate(part):
                yield self._one(q, bounds[i], k, own[start + i], floors[start + i])

    def _one(self, q, bound, k, own, floor):
        heap = [(-bound[0], 0)]
        scores, ids = self.x[:0] @ q, self.ids[:0]
        while heap:
            b, node = heapq.heappop(heap)
            if floor is not None and -b < floor:
                break
            if self.kids[node]:
                for child in self.kids[node]:
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, e = self.spans[node]
            s = self.x[a:e] @ q
            keep = self.ids[a:e] != own
            if floor is not None:
                keep &= s >= floor
            if not keep.any():
                continue
            scores, ids = np.concatenate([scores, s[keep]]), np.concatenate([ids, self.ids[a:e][keep]])
            if len(scores) >= k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                floor = scores[-1] if floor is None else max(floor, scores[-1])
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def _matrix(rows) -> np.ndarray:
    """Rows of equal length as float64 where every score is exact in it, else as Python integers."""
    if not len(rows):
        return np.zeros((0, 0))
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows]).reshape(len(rows), -1)
    return x


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if x.size and y.size and float(np.abs(x).max()) * float(np.abs(y).max()) * max(1, x.shape[1]) >= 2.0**52:
        return tuple(np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (x, y))
    return x, y


FOUND = "query_id long, vec_id long, score long"


def top_k(rows: DataFrame, k: int, query_every: int, stage: Stage, shard_rows: int = 8192, query_rows: int = 4096, leaf_rows: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. rows: (vec_id, v) with v an array of whole-number doubles, one row for each vec_id."""
    held = stage.write(rows.withColumn("d", F.size("v")), "vectors")
    n, wide = held.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(1))).first()
    # long vectors make smaller shards and blocks: a task holds at most about VALUES numbers of either
    shard_rows, query_rows = (max(1, min(r, VALUES // max(1, wide))) for r in (shard_rows, query_rows))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (query_every * query_rows)))
    held = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = F.col("vec_id") % query_every == 0

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        """k-th score of each query in its own shard."""
        one_thread()
        names = pdf["vec_id"].to_numpy()
        x, _ = _exact(_matrix(pdf["v"]), _matrix(pdf["v"]))
        mine = np.flatnonzero(names % query_every == 0)
        floors = []
        if len(mine):
            for s, _ids in Tree(names, x, leaf_rows).search(x[mine], k, names[mine], [None] * len(mine)):
                floors.append(int(s[-1]) if len(s) == k else None)
        return pd.DataFrame({"vec_id": names[mine], "v": pdf["v"].to_numpy()[mine], "d": pdf["d"].to_numpy()[mine], "floor": pd.array(floors, dtype="Int64")})

    queries = stage.write(held.groupBy("shard", "d").applyInPandas(first, "vec_id long, v array<double>, d int, floor long"), "queries")

    def search(key, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        if not len(pdf) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, q = _exact(_matrix(pdf["v"]), _matrix(asked["v"]))
        names = asked["vec_id"].to_numpy()
        floors = [None if pd.isna(f) else int(f) for f in asked["floor"]]
        out = [(np.full(len(s), name), i, s) for name, (s, i) in zip(names, Tree(pdf["vec_id"].to_numpy(), x, leaf_rows).search(q, k, names, floors))]
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]).astype(np.int64) for j, c in enumerate(("query_id", "vec_id", "score"))})

    # a shard meets every block of queries of its dimension: each side is sent once to each of the other's parts
    left = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block", "d").cogroup(right.groupBy("shard", "block", "d")).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """Each query's k best rows by integer inner product of floor(scale * x).

    Rows with a null vec_id, a null vector, or null or non-finite components take no part. A vector is compared with those of its own length. Ties go to
    the smaller vec_id. A repeated row (same vec_id and vector) is one row; of several vectors of one vec_id the least takes part, in the order of arrays. Empty table: no rows. Further
    columns are ignored. A query with fewer than k others gets them all.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    ok = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    rows = rows.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(rows, k, query_every, Stage(spark, "topk"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
