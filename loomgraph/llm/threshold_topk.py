"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks of a fixed size.  Within a block every dimension has its
list sorted by value; a query reads all its lists in step from the favourable end, scores
each vector that it meets, and stops when the sum of the values last read, the most that
any unseen vector can reach, is below its k-th score.  Queries come in blocks too, so that
no task holds more than one block of each; the best of each block meet in a small window.

Defined results: vectors that are null, or hold a null or non-finite component, or have a
null id take no part; rows of the query's own id are never its candidates; of several rows
with one id the vector that sorts lowest counts, once; ties go to the smaller id; only
vectors of equally many dimensions are compared; fewer candidates than k are all returned;
components and scores beyond 64 bits stand at the largest number of their sign, and tie there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, v): floor(scale * x) of each usable vector, one row for each id."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return vectors.select(F.col(key).cast("long").alias("key"), x.alias("x"), v.alias("v")).where(F.col("key").isNotNull() & F.col("x").isNotNull() & usable).groupBy("key").agg(F.min("v").alias("v"))


class SortedLists:
    """A block of vectors with its lists, one for each dimension."""

    def __init__(self, keys: np.ndarray, matrix: np.ndarray):
        order = np.argsort(keys, kind="stable")  # rows by id: ties then fall to the smaller row
        self.keys, self.matrix = keys[order], matrix[order]
        self.lists = np.argsort(self.matrix, axis=0, kind="stable")

    @staticmethod
    def _held(score: np.ndarray | int) -> np.ndarray:
        """Scores in 64 bits, at the largest of their sign where they are beyond."""
        most = (1 << 63) - 1
        return np.array([min(max(int(x), -most), most) for x in np.atleast_1d(score)], np.int64)

    def top(self, own: int, q: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best for query `q` of id `own`, best first."""
        n = len(self.keys)
        dims = np.flatnonzero(q)
        down = q[dims] > 0
        seen = np.zeros(n, bool)
        best_rows, best = np.empty(0, np.int64), np.empty(0, np.int64)
        depth = 0
        while depth < n and len(dims):
            until = min(n, depth + step)
            at = np.arange(depth, until)
            place = np.where(down[None, :], n - 1 - at[:, None], at[:, None])
            met = np.zeros(n, bool)
            met[self.lists[place, dims[None, :]].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[self.keys[new] != own]
            best_rows, best = self._best(np.concatenate([best_rows, new]), np.concatenate([best, self._held(self.matrix[new] @ q) if q.dtype == object else self.matrix[new] @ q]), k)
            depth, step = until, step * 2
            last = np.where(down, n - depth, depth - 1)
            bound = int(self._held((self.matrix[self.lists[last, dims], dims] * q[dims]).sum())[0]) if q.dtype == object else int((self.matrix[self.lists[last, dims], dims] * q[dims]).sum())
            if len(best) == k and bound < best[-1]:  # at equality an unseen smaller id may still win
                return best_rows, best
        if len(dims) == 0:  # the zero query ties with everything
            rest = np.flatnonzero(self.keys != own)[:k]
            return rest, np.zeros(len(rest), np.int64)
        return best_rows, best

    @staticmethod
    def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > 4 * k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= floor
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


def top_k(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all `vectors` for each row where `queries` holds.

    `queries` is a condition on the column `key`.  A task holds at most about `block_rows`
    candidates and `query_rows` queries, however many there are in all.
    """
    q = quantised(vectors, key, vector, scale).withColumn("dims", F.size("v"))
    n, nq = q.agg(F.count("*"), F.count_if(queries)).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))
    lane = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    query_lane = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(query_blocks)).cast("int")
    candidates = q.withColumn("b", lane).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = q.where(queries).withColumn("qb", query_lane).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(ours) and len(theirs):
            matrix, asked = (np.stack(x["v"].to_numpy()).astype(np.int64).reshape(len(x), -1) for x in (ours, theirs))
            largest = [float(np.abs(x.astype(float)).max(initial=0)) for x in (matrix, asked)]
            # whole numbers of any size where 64 bits might not do
            kind = object if largest[0] * largest[1] * max(1, matrix.shape[1]) >= 2.0**62 else np.int64
            index = SortedLists(ours["key"].to_numpy(np.int64), matrix.astype(kind))
            for own, v in zip(theirs["key"].tolist(), asked.astype(kind), strict=True):
                rows, scores = index.top(own, v, k)
                found.append((np.full(len(rows), own), index.keys[rows], scores))
        cols = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [(), (), ()])]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]}).astype("int64")

    near = candidates.groupBy("b", "qb", "dims").cogroup(asked.groupBy("b", "qb", "dims")).applyInPandas(search, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
