"""Nearest neighbours with vantage-point trees, one for each shard of the rows.

A shard's tree splits its vectors at the median distance from a vantage point, over
and over, and keeps the least and greatest distance on either side.  A query leaves
a side out if the triangle inequality shows that nothing there is nearer than its
k-th best so far: ``factor * (bound) > best``.  Factor 1 is exact; a larger one leaves
out more and may miss neighbours.  All queries of a block walk a tree together.

Shards hold about ``shard_rows`` rows and blocks about ``block_queries`` queries;
each task pairs one shard with one block, so memory is bounded for any input, and a
query's k best of each shard meet in a window that ranks them.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor does a null vec_id; vectors are compared with those of
their own length; a query is never its own neighbour (nor are rows that share its
vec_id), and of repeated query rows the least vector counts; ties go to the smaller
vec_id; with fewer candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
_SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b, summed component by component."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return np.sqrt(total)


class VantageTree:
    """A tree over the rows of ``points`` (with ``ids``)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _build(self, rows: np.ndarray, rng) -> tuple:
        todo: list = [None]
        stack = [(rows, todo, 0)]
        while stack:  # no recursion: repeated vectors give deep sides
            rows, parent, slot = stack.pop()
            if len(rows) <= LEAF:
                parent[slot] = (rows,)
                continue
            at = rng.integers(len(rows))
            d = _distances(self.points[rows[at]][None], self.points[rows])[0]
            cut = np.median(d)
            near = d <= cut
            if near.all():
                near = d < cut
            if not near.any():  # all at one distance: no split
                parent[slot] = (rows,)
                continue
            node = [rows[at], [d[near].min(), d[near].max(), d[~near].min(), d[~near].max()], None, None]
            parent[slot] = node
            stack += [(rows[near], node, 2), (rows[~near], node, 3)]
        return todo[0]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k best of each query, nearest first, open places
        infinite; rows whose id is the query's ``own`` are left out."""
        n = len(queries)
        best, found = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

        def scan(rows: np.ndarray, who: np.ndarray) -> None:
            for lo in range(0, len(rows), 1024):
                part = rows[lo:lo + 1024]
                for q in range(0, len(who), 512):
                    w = who[q:q + 512]
                    d = _distances(queries[w], self.points[part])
                    d[self.ids[part][None] == own[w][:, None]] = np.inf
                    hit = (d <= best[w, -1:]).any(axis=1)
                    if not hit.any():
                        continue
                    w, d = w[hit], d[hit]
                    d = np.concatenate((best[w], d), axis=1)
                    i = np.concatenate((found[w], np.broadcast_to(self.ids[part], (len(w), len(part)))), axis=1)
                    i = np.where(np.isinf(d), np.iinfo(np.int64).max, i)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best[w], found[w] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        def open_(low: np.ndarray, who: np.ndarray) -> np.ndarray:
            return factor * low <= best[who, -1] * (1 + _SLACK) + _SLACK

        def walk(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                scan(node[0], who)
                return
            vantage, (a, b, c, e), inner, outer = node
            d = _distances(queries[who], self.points[vantage][None])[:, 0]
            low_in, low_out = np.maximum(d - b, a - d), np.maximum(c - d, d - e)
            first_in = low_in <= low_out
            for mine, one, two, low_one, low_two in ((first_in, inner, outer, low_in, low_out), (~first_in, outer, inner, low_out, low_in)):
                group = who[mine]
                walk(one, group[open_(low_one[mine], group)])
                walk(two, group[open_(low_two[mine], group)])

        if len(self.ids):
            walk(self.root, np.arange(n))
        return best, found


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 8192, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest ``rows`` of each of ``queries``
    (both vec_id, vector)."""
    rows, queries = (t.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
                     .filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))) for t in (rows, queries))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))

    def part(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    size = F.size("vector").alias("size")
    left = rows.select("vec_id", "vector", size, part(shards, "shard").alias("shard"), every(blocks).alias("block"))
    right = queries.select("vec_id", "vector", size, part(blocks, "block").alias("block"), every(shards).alias("shard"))

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = np.asarray(t.column("vec_id").combine_chunks())
            flat = np.asarray(t.column("vector").combine_chunks().flatten())
            return ids, flat.reshape(len(ids), -1 if len(ids) else 1)
        (ids, points), (own, q) = matrix(mine), matrix(asked)
        d, i = VantageTree(points, ids).search(q, own, k, factor) if len(ids) and len(own) else (np.zeros((0, k)), np.zeros((0, k), dtype=np.int64))
        got = np.isfinite(d)
        return pa.table({"query_id": np.repeat(own, k).reshape(-1, k)[got] if len(d) else own[:0], "vec_id": i[got], "score": d[got]})

    keys = ["size", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
