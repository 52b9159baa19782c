"""Hard negatives of anchor rows, found through bounds along a spanning tree of the anchors.

Vectors are whole numbers, a score is their inner product. For anchors p and q, |<q, c> - <p, c>| <= |q - p| |c|: a score
at p plus or minus the edge's length times the candidate's norm bounds the score at q. Anchors are taken in
groups of at most `GROUP`, similar ones together, each with a minimum spanning tree. Down the tree every
anchor gets bounds for all candidates from its parent's scores or bounds, and only candidates
whose bounds reach into the anchor's window are scored. The root scores all.

Two rounds are needed, as the windows of the second come from the first:

1. An anchor's positives are its `K` best other rows of the same label: the window is open above, and begins at the
   `K`-th highest of the lower bounds.
2. For each positive the `K` best rows of another label with a score of `LOW` to 100 percent of the positive's.

Candidates are dealt over shards of about `SHARD_ROWS` rows by the hash of their id, a task a shard; the groups pass every
shard, and a shard gives at most `K` rows for each question, which are merged by score, then id. A task holds a shard and
one group. All rows against every anchor is what is asked for; the bounds save scoring, not the meeting.

Rows with a null id, label or vector, or with null or non-finite components take no part. Of different rows with one id
the least by dimension, label, then vector counts; an anchor's own id is never its positive or negative. Rows of
different dimensions do not meet. Equal scores go by smaller id. An anchor without positives, or a positive without rows in
its window, gives no rows, nor do empty tables. A component beyond 2^40 after scaling, or a score beyond 2^56,
fails the job. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuetrace.llm.jobs import arrow_map, store
from cuetrace.llm.vectors import finite, matrix, products, whole

K = 5
LOW = 80
SCALE = 256
GROUP = 64
PIVOTS = 64
SHARD_ROWS = 8_192

ANCHORS = "dim int, ids array<long>, labels array<long>, x binary, parents array<int>, lengths array<double>"


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order in which they join the tree, each one's parent (-1 for the first) and the edge's length."""
    x = x.astype(float)
    n = len(x)
    order, parent, length = [0], np.zeros(n, np.int32), np.linalg.norm(x - x[0], axis=1)
    parent[0], open_ = -1, np.ones(n, bool)
    open_[0] = False
    while len(order) < n:
        new = int(np.argmin(np.where(open_, length, np.inf)))
        open_[new] = False
        order.append(new)
        away = np.linalg.norm(x - x[new], axis=1)
        nearer = open_ & (away < length)
        parent[nearer], length[nearer] = new, away[nearer]
    length[0] = 0.0
    return np.array(order), parent, length


def prepared(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """(vec_id, label, x, asks) of the rows that take part."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & finite(F.col("embedding")))
    return rows.select("vec_id", label.cast("long").alias("label"), whole(F.col("embedding"), SCALE).alias("x"),
                       F.coalesce(is_anchor, F.lit(False)).alias("asks"))


def anchor_groups(rows: DataFrame) -> DataFrame:
    """Stored groups of at most `GROUP` anchors with their spanning trees. Anchors nearest to the same of `PIVOTS`
    anchors (those with the smallest hashes; they shape the trees, not the result) are neighbours in the order
    that is cut into groups."""
    asking = rows.filter("asks").groupBy("vec_id").agg(
        F.min(F.struct(F.size("x").alias("dim"), "label", "x")).alias("r")).select("vec_id", "r.label", "r.x", "r.dim")
    asking = store(asking, "anchors")
    pivots: dict[int, list] = {}
    for row in asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect():
        pivots.setdefault(row["dim"], []).append(row["x"])
    points = {dim: np.array(x, float).reshape(len(x), dim) for dim, x in pivots.items()}

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            near = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in points and dim:
                    own = matrix(batch.column("x").take(pa.array(at)), dim).astype(float)
                    # Squared distances to all pivots, but for the row's own length.
                    near[at] = np.argmin((points[dim] ** 2).sum(axis=1) - 2 * own @ points[dim].T, axis=1)
            yield {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": batch.column("x"),
                   "dim": batch.column("dim"), "pivot": near}

    placed = arrow_map(asking, place, "vec_id long, label long, x array<long>, dim int, pivot int")
    parts = max(1, -(-asking.count() // (16 * GROUP)))
    dealt = placed.repartitionByRange(parts, "dim", "pivot", "vec_id").sortWithinPartitions("dim", "pivot", "vec_id")

    def trees(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for begin, end in zip(cuts, cuts[1:]):
                for first in range(begin, end, GROUP):
                    part = batch.slice(first, min(GROUP, end - first))
                    dim = int(dims[first])
                    x = matrix(part.column("x"), dim)
                    order, parent, length = spanning_tree(x)
                    number = np.empty(len(order), np.int64)
                    number[order] = np.arange(len(order))
                    parents = [int(number[p]) if p >= 0 else -1 for p in parent[order]]
                    yield {"dim": [dim], "ids": [part.column("vec_id").to_numpy()[order].tolist()],
                           "labels": [part.column("label").to_numpy()[order].tolist()], "x": [x[order].tobytes()],
                           "parents": [parents], "lengths": [length[order].tolist()]}

    return store(arrow_map(dealt, trees, ANCHORS), "anchor-groups")


class Shard:
    """The candidates of a task, of one dimension, by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], labels, ids))
        ids, labels, x = ids[order], labels[order], x[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = ids[1:] != ids[:-1]
        self.ids, self.labels, self.x = ids[fresh], labels[fresh], x[fresh]
        self.norms = np.linalg.norm(self.x.astype(float), axis=1) * (1 + 1e-9)
        self.scored = 0

    def walk(self, group: dict, window):
        """For each anchor of the group, rows that may be in its window and their exact scores.

        `window(anchor, low, high)` gives the rows to score, from bounds for all rows.
        """
        x = np.frombuffer(group["x"], np.int64).reshape(len(group["ids"]), group["dim"])
        low, high = np.zeros((2, len(x), len(self.ids)))
        for a, (parent, length) in enumerate(zip(group["parents"], group["lengths"])):
            if parent < 0:
                low[a], high[a] = -np.inf, np.inf
                rows = np.arange(len(self.ids))
            else:
                reach = length * (1 + 1e-9) * self.norms + 1.0
                low[a], high[a] = low[parent] - reach, high[parent] + reach
                rows = window(a, low[a], high[a])
            score = products(self.x[rows], x[a:a + 1])[:, 0]
            low[a][rows] = high[a][rows] = score
            self.scored += len(rows)
            yield a, rows, score

    def positives(self, group: dict, k: int) -> dict:
        """Each anchor's k best other rows of its label."""
        ids, labels = group["ids"], group["labels"]
        out = []

        def window(a, low, high):
            own = np.flatnonzero((self.labels == labels[a]) & (self.ids != ids[a]))
            if len(own) <= k:
                return own
            least = np.partition(low[own], len(own) - k)[len(own) - k]
            return own[high[own] >= least]

        for a, rows, score in self.walk(group, window):
            own = (self.labels[rows] == labels[a]) & (self.ids[rows] != ids[a])
            rows, score = rows[own], score[own]
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(best), ids[a]), self.ids[rows[best]], score[best]))
        return dict(zip(("anchor_id", "vec_id", "score"), map(np.concatenate, zip(*out))))

    def negatives(self, group: dict, positives: dict[int, list[tuple[int, int]]], k: int, low_percent: int) -> dict:
        """For each anchor and positive the k best rows of another label in the positive's window."""
        ids, labels = group["ids"], group["labels"]
        out = [(np.zeros(0, np.int64),) * 5]

        def window(a, low, high):
            inside = np.zeros(len(self.ids), bool)
            for _, score in positives.get(ids[a], ()):
                inside |= (100 * high >= low_percent * score) & (low <= score)
            return np.flatnonzero(inside & (self.labels != labels[a]))

        for a, rows, score in self.walk(group, window):
            other = (self.labels[rows] != labels[a]) & (self.ids[rows] != ids[a])
            rows, score = rows[other], score[other]
            order = np.lexsort((self.ids[rows], -score))
            rows, score = rows[order], score[order]
            for name, most in positives.get(ids[a], ()):
                at = np.flatnonzero((low_percent * most <= 100 * score) & (score <= most))[:k]
                out.append((np.full(len(at), ids[a]), np.full(len(at), name), np.full(len(at), most),
                            self.ids[rows[at]], score[at]))
        names = ("anchor_id", "positive_id", "positive_score", "vec_id", "score")
        return dict(zip(names, map(np.concatenate, zip(*out))))


def _meet(rows: DataFrame, groups: DataFrame, shards: int, answer, schema: str) -> DataFrame:
    """`answer(shard, group)` for every shard and group; a task has one shard, and the groups stream past it."""
    fields = groups.schema.fields
    names = groups.columns
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    held = rows.select(shard, F.lit(0).alias("asks"), F.size("x").alias("dim"), "vec_id", "label", F.col("x").alias("v"),
                       *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "dim"])
    asking = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "dim",
        F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("label"),
        F.lit(None).cast("array<long>").alias("v"), *[name for name in names if name != "dim"])
    dealt = held.unionByName(asking).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")

    def run(batches):
        key, parts, shard, earlier = (None, None), [], None, np.zeros(0, np.int64)
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "asks")])
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if end == begin:
                    continue
                number, dim, asks = at[:, begin].tolist()
                if key != (number, dim):
                    # Ids of smaller dimensions; those of the shard before are no matter.
                    earlier = np.concatenate([earlier, *(ids for ids, _, _ in parts)]) if key[0] == number else earlier[:0]
                    key, parts, shard = (number, dim), [], None
                part = batch.slice(begin, end - begin)
                if not asks:
                    new = ~np.isin(part.column("vec_id").to_numpy(), earlier)
                    parts.append((part.column("vec_id").to_numpy()[new], part.column("label").to_numpy()[new],
                                  matrix(part.column("v"), dim)[new]))
                    continue
                if not parts:
                    continue
                if shard is None:
                    shard = Shard(*map(np.concatenate, zip(*parts)))
                for i in range(part.num_rows):
                    group = {name: part.column(name)[i].as_py() for name in names}
                    yield answer(shard, group)

    return arrow_map(dealt, run, schema)


def _first(found: DataFrame, question: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*question).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, *, k: int = K, low: int = LOW,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `vectors` has vec_id and embedding."""
    rows = prepared(vectors, label, is_anchor)
    groups = anchor_groups(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    found = _meet(rows.drop("asks"), groups, shards, lambda shard, group: shard.positives(group, k),
                  "anchor_id long, vec_id long, score long")
    positives = _first(found, ["anchor_id"], k).groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))  # at most k
    positives = store(positives, "positives")
    # Each group takes its anchors' positives along.
    own = groups.select("*", F.monotonically_increasing_id().alias("number"))
    own = store(own, "numbered-groups")
    told = own.select("number", F.explode("ids").alias("anchor_id")).join(positives, "anchor_id").groupBy("number").agg(
        F.collect_list(F.struct("anchor_id", "found")).alias("positives"))  # at most GROUP
    asked = own.join(told, "number").drop("number")

    def answer(shard: Shard, group: dict) -> dict:
        known = {p["anchor_id"]: [(f["vec_id"], f["score"]) for f in p["found"]] for p in group["positives"]}
        return shard.negatives(group, known, k, low)

    mined = _meet(rows.drop("asks"), asked, shards, answer,
                  "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    return _first(mined, ["anchor_id", "positive_id"], k).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
