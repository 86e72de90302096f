"""Nearest neighbours by hash-prefix forests.

Rows are dealt to shards of bounded size; each shard is indexed by a forest: per tree, the rows sorted by a long string
of bits (signs of projections on orthonormal directions, around the shard's mean). A query descends in all trees to the
longest prefix it shares with any row, then ascends in all trees together, one bit at a time, collecting the rows of
the widening ranges until it has met a given share of the shard. Met rows are scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for

TOP = 10
TREES = 48
BITS = 32
SHARE = 0.8
SHARD = 8192
BLOCK = 1 << 22


class Forest:
    """Sorted bit strings of some vectors, one order per tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        rng = np.random.default_rng(20240229)
        d = vectors.shape[1]
        blocks = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-trees * bits // d))]
        self.bits, self.mean = bits, vectors.mean(0)
        self.directions = np.concatenate(blocks, 1)[:, : trees * bits].reshape(d, trees, bits)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Bit strings (row, tree), the first bit highest."""
        trees = self.directions.shape[1]
        out = np.zeros((len(vectors), trees), np.int64)
        for t in range(trees):
            signs = (vectors - self.mean) @ self.directions[:, t] > 0
            out[:, t] = signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))
        return out

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place (level, query, tree) of the rows that share that many leading bits."""
        n, trees = strings.shape
        low, high = (np.empty((self.bits + 1, n, trees), np.int64) for _ in range(2))
        for t in range(trees):
            for x in range(self.bits + 1):
                free = self.bits - x
                first = strings[:, t] >> free << free
                low[x, :, t] = np.searchsorted(self.sorted[:, t], first)
                high[x, :, t] = np.searchsorted(self.sorted[:, t], first + (1 << free))
        return low, high

    def candidates(self, queries: np.ndarray, most: int) -> list[np.ndarray]:
        """Rows met by each query: from the longest prefixes upward, whole levels, then trees of the last level, until
        the ranges hold ``most`` rows (a row in several trees counts in each)."""
        low, high = self.ranges(self.strings(queries))
        sizes = high - low
        totals = sizes.sum(2)
        found = []
        for q in range(len(queries)):
            level = int(np.flatnonzero(totals[:, q] >= most)[-1]) if totals[0, q] >= most else 0
            deeper = min(level + 1, self.bits)
            gain = np.cumsum(sizes[level, q] - sizes[deeper, q]) + totals[deeper, q]
            opened = np.searchsorted(gain, most) + 1
            met = np.zeros(len(self.order), bool)
            for t in range(sizes.shape[2]):
                x = level if t < opened else deeper
                met[self.order[low[x, q, t] : high[x, q, t], t]] = True
            found.append(np.flatnonzero(met))
        return found


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP, share: float = SHARE, trees: int = TREES) -> tuple[list, list, list]:
    """Per query the ``top`` nearest met rows other than its own: query, row, distance."""
    forest = Forest(vectors, trees)
    out: tuple[list, list, list] = ([], [], [])
    for q, rows in enumerate(forest.candidates(queries, max(top + 1, int(share * len(ids))))):
        rows = rows[ids[rows] != query_ids[q]]
        distance = np.sqrt(((vectors[rows] - queries[q]) ** 2).sum(1))
        if len(rows) > top:
            edge = np.partition(distance, top - 1)[top - 1]
            rows, distance = rows[distance <= edge], distance[distance <= edge]
        best = np.lexsort((ids[rows], distance))[:top]
        out[0].extend([query_ids[q]] * len(best))
        out[1].extend(ids[rows[best]].tolist())
        out[2].extend(distance[best].tolist())
    return out


def usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds only finite numbers."""
    v = F.col(vector)
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return frame.where(good)


def search(frame: DataFrame, is_query: Callable[[DataFrame], DataFrame], top: int = TOP, share: float = SHARE, trees: int = TREES, shard_rows: int = SHARD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest rows found for each query row.

    Euclidean distance in double precision, ties to the smaller id. Vectors that are null, empty, zero or not finite
    take no part, nor do rows without an id (they could be neither named as a result nor asked as a query); vectors
    are compared only with those of their length. Rows with one id count once (any of equal vectors; of different ones
    each is a candidate). Queries and rows meet in blocks of at most about ``shard_rows`` each.
    """
    rows = frame.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    rows = usable(rows, "v").withColumn("d", F.size("v"))
    queries = is_query(rows.withColumnRenamed("vec_id", key)).withColumnRenamed(key, "query_id")
    shards, groups = buckets_for(rows.count(), shard_rows), buckets_for(queries.count(), shard_rows)
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def matrix(table: pa.Table) -> np.ndarray:
        values = table.column("v").combine_chunks()
        return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def meet(near: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.float64()]
        if not near.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        near = near.sort_by("vec_id")
        found = nearest(near.column("vec_id").to_numpy(), matrix(near), asked.column("query_id").to_numpy(), matrix(asked), top, share, trees)
        return pa.table([pa.array(x, t) for x, t in zip(found, types, strict=True)], names)

    keys = ("d", "shard", "part")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
