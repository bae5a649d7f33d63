"""Nearest neighbours with vantage-point trees per shard.

Vectors are dealt to shards of bounded size by a hash of their id; each shard builds a tree in which
a node splits its points at the median distance to a vantage point and keeps the range of distances
on either side. A query skips a subtree when factor x (lower bound from the triangle inequality)
exceeds its current k-th distance: factor one is exact, a larger one skips more and may miss some.

Defined cases: vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part; equal vectors are ranked by vec_id; rows repeated with the same
vec_id and vector count once; rows with the same vec_id but other vectors are candidates each, and
are asked each if the id is a query's; a null vec_id takes no part; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Vectors of one tree, and queries that are sent to a tree together.
SHARD_ROWS, QUERY_ROWS = 8_192, 2_048
LEAF = 64


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order (so equal for any blocking).

    ``points`` (n, d) to ``query`` (d,) or, pairwise, (n, d).
    """
    step = points - query
    return np.sqrt(np.cumsum(step * step, axis=1)[:, -1])


class Tree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], np.ascontiguousarray(points[order])
        self.leaf = leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = int(rows[(len(rows) * 7919) % len(rows)])
        d = distances(self.points[rows], self.points[vantage])
        if d.max() == d.min():
            return rows  # copies of one vector: no distance separates them
        middle = np.median(d)
        near = d <= middle
        if near.all():
            near = d < middle
        parts = []
        for side in (near, ~near):
            parts.append((float(d[side].min()), float(d[side].max()), self._build(rows[side])))
        return vantage, parts

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k nearest rows (ids, distances), nearest first, its own id left out.

        Queries go through the tree together; each keeps its own k-th distance, and a node is entered
        by those that cannot rule it out. The first descent, to the nearest leaf, only sets that distance.
        """
        n = len(queries)
        self._q, self._qid, self._k = queries, query_ids, k
        self._best = [(np.empty(0, np.int64), np.empty(0)) for _ in range(n)]
        self._reach = np.full(n, np.inf)
        self._factor = factor
        self._seen: dict[int, np.ndarray] = {}
        self._descend(self.root, np.arange(n))
        self._scan(self.root, np.arange(n))
        return self._best

    def _look(self, rows: np.ndarray, active: np.ndarray) -> None:
        """Compares the active queries with a leaf; a product of matrices tells which can have a nearer row."""
        seen = self._seen.setdefault(int(rows[0]), np.zeros(len(self._q), bool))
        active = active[~seen[active]]
        seen[active] = True
        points, ids = self.points[rows], self.ids[rows]
        asked = self._q[active]
        sizes = (points * points).sum(1)[None, :] + (asked * asked).sum(1)[:, None]
        square = sizes - 2 * (asked @ points.T)
        reach = self._reach[active][:, None]
        near = (square <= reach * reach + 1e-9 * (sizes + 1)) & (ids[None, :] != self._qid[active][:, None])
        for at in np.flatnonzero(near.any(axis=1)).tolist():
            i, some = int(active[at]), near[at]
            d = distances(points[some], self._q[i])
            best_ids, best_d = np.concatenate([self._best[i][0], ids[some]]), np.concatenate([self._best[i][1], d])
            order = np.lexsort((best_ids, best_d))[: self._k]
            self._best[i] = best_ids[order], best_d[order]
            if len(order) == self._k:
                self._reach[i] = best_d[order[-1]]

    def _descend(self, node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self._look(node, active)
            return
        side = np.argmin(self._bounds(node, active), axis=1)
        for s, (_, _, child) in enumerate(node[1]):
            if (side == s).any():
                self._descend(child, active[side == s])

    def _bounds(self, node, active: np.ndarray) -> np.ndarray:
        """Lower bounds (query, side) from the triangle inequality, a rounding error below."""
        vantage, parts = node
        d = distances(self._q[active], self.points[vantage])
        low = np.stack([np.maximum(np.maximum(a - d, d - b), 0) for a, b, _ in parts], axis=1)
        return low * (1 - 1e-9) - 1e-12

    def _scan(self, node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self._look(node, active)
            return
        low = self._bounds(node, active)
        for s in (0, 1):
            # distances found on the first side narrow the second
            stay = self._factor * low[:, s] <= self._reach[active]
            if stay.any():
                self._scan(node[1][s][2], active[stay])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of vectors that take part; components in double precision."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("vector", lambda x: x != 0)).distinct()


def search(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query (vec_id divisible by ``every``).

    A task holds one shard and one block of queries, both bounded; every block meets every shard, and
    the shards' k nearest are merged per query.
    """
    rows = cut_lineage(usable(vectors))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, total = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("vector") == dim)
    asked = rows.where(F.col("vec_id") % every == 0)
    n_queries = asked.count()
    n_shards, n_blocks = max(1, -(-total // shard_rows)), max(1, -(-n_queries // query_rows))
    # salted with a constant, as the queries were dealt by the plain id
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks)).cast("int")
    index = rows.select("vec_id", "vector", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    probe = asked.select("vec_id", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        tree = Tree(left["vec_id"].to_numpy(np.int64), np.stack(left["vector"].to_numpy()))
        ids = right["vec_id"].to_numpy(np.int64)
        best = tree.search(ids, np.stack(right["vector"].to_numpy()), k, factor)
        return pd.DataFrame({
            "query_id": np.repeat(ids, [len(b[0]) for b in best]),
            "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best]),
        })

    found = index.groupBy("shard", "block").cogroup(probe.groupBy("shard", "block")).applyInPandas(look, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
