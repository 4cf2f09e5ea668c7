"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of equal size that
keep neighbours together, and a small classifier learns which part a vector belongs to.
Every vector is then filed under its most probable part, every query is routed to several
of its most probable parts, and what those hold is scored exactly on the original vectors.

How many parts a query visits is found on the sample too: as few as give the wanted share
of the true neighbours of held-out sample vectors.  The number of parts grows with the
vectors up to `most_parts`; crowded parts are split into blocks of bounded rows.

Nearness is the largest inner product.  Defined results: vectors that are null, all zero,
or hold a null or non-finite component, or have a null id take no part; vectors of other
numbers of dimensions than the most usual one are searched among their own, wholly, each
number as one part in blocks; of several rows with one id the vector that sorts lowest
counts, once; rows of the query's id are never its candidates; ties go to the smaller id;
a query whose usual parts hold fewer than k candidates visits as many more as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): double vectors that take part, one row for each id."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))) & F.exists("v", lambda e: e != 0.0)
    some = vectors.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull()).where(good)
    return some.groupBy("key").agg(F.min("v").alias("v"))


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Part of each row, parts of equal size (one row apart at most) that keep neighbours together.

    Starts from balanced nearest centres; then rows move to the part that holds most of
    their neighbours, those with most to gain first, as long as there is room.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(n, parts, replace=False)]
    room = -(-n // parts)
    part = np.zeros(n, np.int64)
    votes = x @ centre.T
    for r in range(rounds):
        best = np.sort(votes, axis=1)
        sure = best[:, -1] - best[:, -2] if parts > 1 else best[:, 0]
        left = np.full(parts, room)
        for i in np.argsort(-sure, kind="stable"):
            for p in np.argsort(-votes[i], kind="stable"):
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        held = np.zeros((n, parts))
        np.add.at(held, (np.arange(n)[:, None], part[neighbours]), 1.0)
        mean = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centre[p] for p in range(parts)])
        near = x @ mean.T
        votes = held / neighbours.shape[1] + near / max(1e-12, float(np.abs(near).max()))
    return part


@dataclass
class Router:
    """A one-hidden-layer classifier of vectors into parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def train_router(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int = 30, seed: int = 5) -> Router:
    """Fit by Adam to `target`, the share of each row's neighbours that each part holds."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    params = [rng.normal(0, np.sqrt(2 / d) / max(1e-12, x.std() * np.sqrt(d)), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            at = order[lo : lo + 128]
            h = x[at] @ params[0] + params[1]
            a = np.maximum(h, 0.0)
            z = a @ params[2] + params[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target[at]) / len(at)
            da = (dz @ params[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ da, da.sum(axis=0), a.T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*params, visits=parts)


def nearest(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each of `rows`, itself left out."""
    out = []
    for lo in range(0, len(rows), 512):
        s = x[rows[lo : lo + 512]] @ x.T
        s[np.arange(len(s)), rows[lo : lo + 512]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def learn(sample: np.ndarray, parts: int, k: int, recall: float, seed: int = 11) -> Router:
    """Cut the sample's neighbour graph, train the router, and find how many parts to visit.

    Runs on a sample of bounded rows.
    """
    n = len(sample)
    k = max(1, min(k, n - 1))
    graph = nearest(sample, np.arange(n), k)
    part = balanced_parts(sample, graph, parts)
    share = np.zeros((n, parts))
    np.add.at(share, (np.arange(n)[:, None], part[graph]), 1.0 / k)
    own = np.zeros((n, parts))
    own[np.arange(n), part] = 1.0
    held = np.random.default_rng(seed).permutation(n) < max(1, n // 5)
    router = train_router(sample[~held], (share + own)[~held] / 2, hidden=64)
    filed = router.best(sample, 1)[:, 0]  # where the index would put them
    order = router.best(sample[held], parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, filed[graph[held]], axis=1)
    found = np.array([(needed < b).mean() for b in range(1, parts + 1)])
    router.visits = int(np.argmax(found >= min(recall, found[-1]))) + 1
    return router


def search(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 6000, part_rows: int = 256, recall: float = 0.95, most_parts: int = 64, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all `vectors` for each query.

    `queries` is a condition on the column `key`.  `sample_rows` bounds the rows that the
    partitioning is learned from (those of lowest hash), `recall` is the share of true
    neighbours that visits are chosen for, `block_rows` bounds what a task holds of a part.
    """
    v = usable(vectors, key, vector).withColumn("dims", F.size("v"))
    usual = v.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return empty
    # parts of their own, numbered below zero, for all other numbers of dimensions
    other = stash(v.where(F.col("dims") != usual["dims"]).select("key", "v", (-F.col("dims")).alias("part")))
    v = stash(v.where(F.col("dims") == usual["dims"]).select("key", "v"))
    n = v.count()
    h = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30))
    sample = v.where(h < int(min(1.0, sample_rows / n) * (1 << 30))).orderBy("key").limit(2 * sample_rows).select("v").toPandas()["v"]
    parts = max(1, min(most_parts, -(-n // part_rows), len(sample) // 64))
    if parts > 1:
        router = learn(np.stack(sample.to_numpy()), parts, k, recall)
    else:
        d = usual["dims"]
        router = Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)

    @F.pandas_udf("int")
    def file(x: pd.Series) -> pd.Series:
        return pd.Series(router.best(np.stack(x.to_numpy()), 1)[:, 0].astype(np.int32)) if len(x) else pd.Series([], dtype="int32")

    filed = stash(v.withColumn("part", file("v")))
    sizes = stash(filed.groupBy("part").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / F.lit(block_rows)).cast("int")))
    size = np.zeros(parts, np.int64)  # as many as `most_parts` at most
    for row in sizes.collect():
        size[row["part"]] = row["rows"]

    @F.pandas_udf("array<int>")
    def visit(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        order = router.best(np.stack(x.to_numpy()), parts)
        enough = (np.cumsum(size[order], axis=1) <= k).sum(axis=1) + 1
        return pd.Series([o[: max(router.visits, e)].astype(np.int32) for o, e in zip(order, enough, strict=True)])

    in_block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    blocked = filed.join(F.broadcast(sizes), "part").select("part", in_block, "key", "v")
    asked = v.where(queries).withColumn("parts", visit("v")).select("key", "v", F.explode("parts").alias("part"))
    asked = asked.join(F.broadcast(sizes), "part").select("part", every_block, "key", "v")
    if not other.isEmpty():
        more = other.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
        blocked = blocked.unionByName(other.join(more, "part").select("part", in_block, "key", "v"))
        asked = asked.unionByName(other.where(queries).join(more, "part").select("part", every_block, "key", "v"))

    def score(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ours) and len(theirs):
            ours = ours.sort_values("key")
            keys, x = ours["key"].to_numpy(np.int64), np.stack(ours["v"].to_numpy())
            ask, q = theirs["key"].to_numpy(np.int64), np.stack(theirs["v"].to_numpy())
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                s[ask[lo : lo + 256, None] == keys[None, :]] = -np.inf
                floor = np.partition(s, max(0, len(keys) - k), axis=1)[:, max(0, len(keys) - k)]
                for i in range(len(s)):
                    # a few more than k, so that exact scores decide among those close to the k-th
                    at = np.flatnonzero((s[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) & np.isfinite(s[i])) if np.isfinite(floor[i]) else np.flatnonzero(np.isfinite(s[i]))
                    exact = (x[at] * q[lo + i]).sum(axis=1)
                    order = np.lexsort((keys[at], -exact))[:k]
                    found.append((np.full(len(order), ask[lo + i]), keys[at[order]], exact[order]))
        cols = list(zip(*found, strict=True)) if found else [(), (), ()]
        join = lambda c, kind: np.concatenate(c).astype(kind) if c else np.empty(0, kind)
        return pd.DataFrame({"query_id": join(cols[0], np.int64), "vec_id": join(cols[1], np.int64), "score": join(cols[2], np.float64)})

    by = ["part", "block"]
    near = blocked.groupBy(*by).cogroup(asked.select("part", "block", "key", "v").groupBy(*by)).applyInPandas(score, "query_id long, vec_id long, score double")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best_first).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
