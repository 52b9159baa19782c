"""Nearest neighbours by cosine: a vantage-point tree per shard, searched by batches of queries.

Vectors are dealt evenly over shards by a hash of their id. In a shard, equal vectors are one point (with
the smallest ids that can be asked for), points are scaled to length one, and a tree splits them by their
distance to a vantage point, down to leaves. For a query with k-th best distance t, a branch whose
points are all at least g away (by the triangle inequality) is skipped if `factor` * g > t.
`factor` = 1 is exact search; larger factors skip more and may miss neighbours.
Once t is known, a second pass over the tree collects every point up to t, however many there are, and these are
ranked by cosine and id. Both passes leave `SLACK` for the error of distances, so that ties are all there.
The results of the shards are merged by score, then id. Queries pass each shard in batches, so a task holds
one shard and one batch.

Vectors that are null, of length zero, or with null or non-finite components take no part, nor do rows with a
null id. Vectors are compared with those of equal dimension only. Repeated rows count once; a query never
finds its own id. No vectors or no queries give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuetrace.llm.jobs import arrow_map

SHARD_VECTORS = 16_384
LEAF = 64
K = 5
SLACK = 1e-7  # distances of unit vectors are off by less; near zero they are by about 1.5e-8
BATCH = 1024
PART = 16  # queries whose ties are held together
PAIR_NUMBERS = 1 << 20  # vector components that are compared at a time

FOUND = "query_id long, vec_id long, score double"


@dataclass
class _Node:
    vantage: int
    near: _Node | np.ndarray
    far: _Node | np.ndarray
    near_range: tuple[float, float]
    far_range: tuple[float, float]


class VantageTree:
    """A tree over unit vectors."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.unit, self.leaf = unit, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray) -> _Node | np.ndarray:
        if len(rows) <= self.leaf:
            return rows
        vantage = int(rows[self.random.integers(len(rows))])
        distance = _distances(self.unit[rows], self.unit[vantage:vantage + 1])[:, 0]
        order = np.argsort(distance, kind="stable")
        near, far = order[:len(rows) // 2], order[len(rows) // 2:]
        spread = [(float(distance[part].min()), float(distance[part].max())) for part in (near, far)]
        return _Node(vantage, self._build(rows[near]), self._build(rows[far]), *spread)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each unit query the k nearest points (-1 where there are fewer) and their distances."""
        best = np.full((len(queries), k), np.inf)
        points = np.full((len(queries), k), -1)
        self._visit(self.root, np.arange(len(queries)), queries, best, points, factor)
        return points, best

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, point) with a distance up to the query's `reach`, but for rounding."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self._collect(self.root, np.arange(len(queries)), queries, reach + SLACK, factor, pairs)
        return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2

    def _collect(self, node, active, queries, reach, factor, pairs) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            at, column = np.nonzero(_distances(queries[active], self.unit[node]) <= reach[active, None])
            pairs.append((active[at], node[column]))
            return
        d = _distances(queries[active], self.unit[node.vantage:node.vantage + 1])[:, 0]
        for branch, (low, high) in ((node.near, node.near_range), (node.far, node.far_range)):
            gap = np.maximum(low - d, d - high)
            self._collect(branch, active[factor * gap <= reach[active] + SLACK], queries, reach, factor, pairs)

    def _visit(self, node, active, queries, best, points, factor) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            distance = np.concatenate([best[active], _distances(queries[active], self.unit[node])], axis=1)
            names = np.concatenate([points[active], np.broadcast_to(node, (len(active), len(node)))], axis=1)
            order = np.argsort(distance, axis=1, kind="stable")[:, :best.shape[1]]
            best[active] = np.take_along_axis(distance, order, axis=1)
            points[active] = np.take_along_axis(names, order, axis=1)
            return
        d = _distances(queries[active], self.unit[node.vantage:node.vantage + 1])[:, 0]
        middle = (node.near_range[1] + node.far_range[0]) / 2

        def open_(rows, reach):
            """Those queries whose k-th best is not closer than all of the branch."""
            gap = np.maximum(reach[0] - d[rows], d[rows] - reach[1])
            return active[rows[factor * gap <= best[active[rows], -1] + SLACK]]

        inner, outer = np.flatnonzero(d <= middle), np.flatnonzero(d > middle)
        for rows, branch, reach in ((inner, node.near, node.near_range), (outer, node.far, node.far_range),
                                    (inner, node.far, node.far_range), (outer, node.near, node.near_range)):
            self._visit(branch, open_(rows, reach), queries, best, points, factor)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from first to last component, so that equal pairs have equal scores."""
    return np.cumsum(a * b, axis=1)[:, -1]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _in_turn(a, b) / (np.sqrt(_in_turn(a, a)) * np.sqrt(_in_turn(b, b)))


class _Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        vectors, ids = vectors[order], ids[order]
        _, first, which = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(),
                                    return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        # The k + 1 smallest ids of each point: a query's own id may be one of them.
        by_point = np.lexsort((ids, which))
        which, ids = which[by_point], ids[by_point]
        fresh = np.concatenate([[True], (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])])
        which, ids = which[fresh], ids[fresh]
        # Points that one id has at most: so many times k + 1 points hold k + 1 ids, of which one may be the query's.
        most = int(np.unique(ids, return_counts=True)[1].max())
        self.n_points = min(len(self.vectors), most * (k + 1))
        begins = np.searchsorted(which, np.arange(len(self.vectors) + 1))
        self.members = [ids[a:min(b, a + k + 1)] for a, b in zip(begins, begins[1:])]
        unit = self.vectors / np.sqrt((self.vectors ** 2).sum(axis=1))[:, None]
        self.tree, self.k = VantageTree(unit), k

    def search(self, names: np.ndarray, vectors: np.ndarray, factor: float) -> dict:
        unit = vectors / np.sqrt((vectors ** 2).sum(axis=1))[:, None]
        _, best = self.tree.search(unit, self.n_points, factor)
        # Any number of points may tie, so few queries' pairs are held at a time, and of these the best are kept.
        parts = [self._ranked(names[i:i + PART], vectors[i:i + PART], unit[i:i + PART], best[i:i + PART, -1], factor)
                 for i in range(0, len(names), PART)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def _ranked(self, names, vectors, unit, reach, factor) -> dict:
        at, found = self.tree.within(unit, reach, factor)
        sizes = np.array([len(self.members[p]) for p in found], np.int64)
        score = np.zeros(len(at))
        step = max(1, PAIR_NUMBERS // vectors.shape[1])
        for i in range(0, len(at), step):
            score[i:i + step] = cosine(vectors[at[i:i + step]], self.vectors[found[i:i + step]])
        at, score = np.repeat(at, sizes), np.repeat(score, sizes)
        ids = np.concatenate([self.members[p] for p in found]) if len(found) else np.zeros(0, np.int64)
        other = ids != names[at]
        at, score, ids = at[other], score[other], ids[other]
        order = np.lexsort((-score, ids, at))
        at, score, ids = at[order], score[order], ids[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])
        at, score, ids = at[fresh], score[fresh], ids[fresh]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        top = rank < self.k
        return {"query_id": names[at[top]], "vec_id": ids[top], "score": score[top]}


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = K, factor: float = 1.0,
            shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every row with `is_query`.

    `vectors` has vec_id and embedding.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    shards = max(1, -(-vectors.count() // shard_vectors))
    points = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
                         F.lit(0).alias("asks"), "vec_id", "embedding")
    asking = rows.filter("asks").dropDuplicates(["vec_id", "embedding"]).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id",
        "embedding")
    dealt = points.unionByName(asking).withColumn("dim", F.size("embedding"))
    # A task a shard: a hash of the shards' numbers would put several into one.
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")

    def run(batches):
        key, held, shard = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "asks")])
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if end == begin:
                    continue
                number, dim, asks = at[:, begin].tolist()
                if key != (number, dim):
                    key, held, shard = (number, dim), [], None
                part = batch.slice(begin, end - begin)
                ids = part.column("vec_id").to_numpy()
                values = pa.array(part.column("embedding")).flatten().to_numpy().reshape(-1, dim)
                if not asks:
                    held.append((ids, values))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard = _Shard(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), k)
                for i in range(0, len(ids), BATCH):
                    yield shard.search(ids[i:i + BATCH], values[i:i + BATCH], factor)

    # A query id that several vectors have asks with each; its neighbours are the best over them.
    best = arrow_map(dealt, run, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
