"""Near-duplicate documents by the Jaccard similarity of their word shingles, with signature trees.

Exactly the pairs with |a & b| / |a | b| >= `PERCENT` / 100 are linked; a document's component is the
smallest doc_id reachable by links, its `n_links` the number of other rows it is linked with.

1. Each document becomes a set of 64-bit shingle hashes. Documents with equal sets are one class from then on.
2. Similar sets share one of their first |s| - ceil(0.8 |s|) + 1 shingles in any fixed order, and l of them in l - 1
   more. The order is by hash, with shingles that many documents hold last, so that common passages link few
   documents. With l about a tenth of a set, sets with fewer than l shared shingles there are left out.
   Of the rest, the rarest shared shingles are looked at; classes that share one, also through others, are one
   candidate group.
3. A group's sets travel once to its task; a group above `BLOCK` sets, or as many times `BLOCK_SHINGLES` shingles, is cut
   into blocks, and pairs of blocks are the tasks. There, for each shared shingle, a signature tree is built over the
   sets in the order of their sizes: a node holds the OR of its sets' bitmaps and the range of their sizes. Two nodes
   are traversed together unless their sizes differ too much or the largest possible overlap is too small. At the
   leaves, of `LEAF` sets, the pairs left by the same two bounds are verified on the sets themselves, each pair
   once in all its tasks.
4. A task returns the number of links of each class, weighted by the rows of the other class, and of the links
   themselves as many as connect its sets. Components of these.

The frequent shingles are counted in each batch of documents, and the `FREQUENT` most frequent are broadcast. They
order the search and are salted where shingles are brought together; the result is the same with any others. Words are lower-cased (A-Z) and cut at white space. With fewer words than a shingle has, the whole
sequence is one shingle; without words the set is empty and linked with nothing. Rows with equal doc_id are one
node of the links, but each row counts by itself in `n_links`; a null doc_id is linked with nothing, keeps a null component
and counts nowhere. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cuetrace.llm.components import components
from cuetrace.llm.jobs import arrow_map, store
from cuetrace.llm.words import chunks, grams, words_of

SHINGLE = 5
PERCENT = 80
BLOCK = 4096
BLOCK_SHINGLES = 256  # on average, for each set of a block
BITS = 1024
FANOUT = 8
LEAF = 32
COMMON = 1000  # one in so many documents of a batch, and at least 8, make a shingle frequent
FREQUENT = 1 << 18  # 2 MB of hashes
SALTS = 64

SKETCHES = "doc_id long, n_shingles long, print1 long, print2 long, plain int, prefix array<long>"
SAME = ["print1", "print2", "n_shingles"]
LINKS = "a long, b long, print1 long, print2 long, n_shingles long, n long"


@dataclass
class Sets:
    """The distinct shingles of a few documents, in ascending order."""

    hashes: np.ndarray
    bounds: np.ndarray


def shingle_sets(column: pa.Array) -> Sets:
    w = words_of(column, lower=True)
    bounds = w.bounds()
    n_docs = len(bounds) - 1
    hashes = grams(w.hashes, list(range(SHINGLE)))
    doc = w.doc[:len(hashes)]
    whole = doc == w.doc[SHINGLE - 1:] if len(hashes) else np.zeros(0, bool)
    hashes, doc = hashes[whole], doc[whole]
    counts = np.diff(bounds)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        own = [grams(w.hashes[bounds[d]:bounds[d + 1]], list(range(counts[d])))[0] for d in few.tolist()]
        hashes, doc = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return Sets(hashes, np.searchsorted(doc, np.arange(n_docs + 1)))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def shared_least(n: np.ndarray) -> np.ndarray:
    """How many shingles sets of this size and more are made to share, if they are similar."""
    return n // 10 + 1


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Hashes of the shingles that most documents hold, in ascending order; at most FREQUENT."""
    def run(batches):
        for batch in batches:
            parts = [shingle_sets(part.column("text")).hashes for part in chunks(batch, "text")]
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts >= max(8, batch.num_rows // COMMON)
            yield {"h": values[often].view(np.int64), "n": counts[often]}

    found = arrow_map(documents.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h")
    return np.sort(found.toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _ordered(s: Sets, late: np.ndarray) -> Sets:
    """The sets in the search order: frequent shingles last."""
    doc = np.repeat(np.arange(len(s.bounds) - 1), np.diff(s.bounds))
    order = np.lexsort((s.hashes, _member(s.hashes, late), doc))
    return Sets(s.hashes[order], s.bounds)


def _prints(s: Sets) -> list[np.ndarray]:
    """Two fingerprints of each set, whatever its order."""
    padded = np.append(s.hashes, np.uint64(0))
    prints = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        mixed = padded * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * np.uint64(factor))])
        prints.append((total[s.bounds[1:]] - total[s.bounds[:-1]]).view(np.int64))
    return prints


def sketches(documents: DataFrame, late, percent: int) -> DataFrame:
    """Each document's number of shingles, two fingerprints of its set, and its first shingles, `plain` ones first."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s = _ordered(shingle_sets(part.column("text")), late.value)
                n = np.diff(s.bounds)
                prints = _prints(s)
                size = np.where(n > 0, prefix_length(n, percent) + shared_least(n) - 1, 0)
                size = np.minimum(size, n)
                begins = np.cumsum(size) - size
                take = np.repeat(s.bounds[:-1] - begins, size) + np.arange(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, size.sum()).astype(np.int32)),
                                                 pa.array(s.hashes[take].view(np.int64)))
                often = np.concatenate([[0], np.cumsum(_member(s.hashes, late.value))])
                plain = n - (often[s.bounds[1:]] - often[s.bounds[:-1]])
                yield {"doc_id": part.column("doc_id"), "n_shingles": n, "print1": prints[0], "print2": prints[1],
                       "plain": np.minimum(plain, size), "prefix": lists}

    return store(arrow_map(documents.select("doc_id", "text"), run, SKETCHES), "sketches")


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


@dataclass
class _Node:
    """OR of bitmaps, range of sizes, and how many shingles share a bit with others at most."""

    bits: int
    low: int
    high: int
    excess: int
    children: list
    members: np.ndarray | None


class _Group:
    """The sets of a task, compared through signature trees. `halves` tells two blocks apart, of which only pairs
    across are compared."""

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray, percent: int, halves: np.ndarray | None):
        n = len(sets)
        self.ordered, self.weights, self.percent = sets, weights, percent
        self.sizes = np.array([len(s) for s in sets])
        local = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.local = np.split(local, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(int(local.max()) + 1, np.int32)
        bits = np.zeros((n, BITS), bool)
        for row, own in zip(bits, sets):
            row[(own % np.uint64(BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.excess = self.sizes - bits.sum(axis=1)
        self.side = None if halves is None else halves == halves.max()
        self.place = np.arange(n)
        if self.side is not None:
            self.place = np.where(self.side, np.cumsum(self.side), np.cumsum(~self.side)) - 1
        self.compared = np.zeros((n, n) if self.side is None else (int((~self.side).sum()), int(self.side.sum())), bool)
        self.union, self.links, self.degree = _Union(n), [], np.zeros(n, np.int64)

    def run(self) -> None:
        heads = prefix_length(self.sizes, self.percent)
        member = np.repeat(np.arange(len(self.sizes)), heads)
        shingle = np.concatenate([s[:h] for s, h in zip(self.ordered, heads.tolist())])
        order = np.lexsort((member, self.sizes[member], shingle))
        member, shingle = member[order], shingle[order]
        done = set()
        for group in np.split(member, np.flatnonzero(np.diff(shingle)) + 1):
            if len(group) > 1 and (key := group.tobytes()) not in done:
                done.add(key)
                self._shared(group)

    def _shared(self, group: np.ndarray) -> None:
        """Sets that share a first shingle, by size."""
        level = [self._leaf(group[i:i + LEAF]) for i in range(0, len(group), LEAF)]
        while len(level) > 1:
            level = [self._above(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self._within(level[0])

    def _leaf(self, members: np.ndarray) -> _Node:
        bits = int.from_bytes(np.bitwise_or.reduce(self.bits[members], axis=0).tobytes(), "big")
        sizes = self.sizes[members]
        return _Node(bits, int(sizes[0]), int(sizes[-1]), int(self.excess[members].max()), [], members)

    @staticmethod
    def _above(children: list[_Node]) -> _Node:
        bits = 0
        for child in children:
            bits |= child.bits
        return _Node(bits, children[0].low, children[-1].high, max(c.excess for c in children), children, None)

    def _within(self, node: _Node) -> None:
        """Pairs inside a node."""
        if not node.children:
            a, b = np.triu_indices(len(node.members), 1)
            self._pairs(node.members[a], node.members[b])
        for k, child in enumerate(node.children):
            self._within(child)
            for other in node.children[k + 1:]:
                self._between(child, other)

    def _between(self, a: _Node, b: _Node) -> None:
        if a.high * 100 < self.percent * b.low or b.high * 100 < self.percent * a.low:
            return
        most = (a.bits & b.bits).bit_count() + min(a.excess, b.excess)
        if most * (100 + self.percent) < self.percent * (a.low + b.low):
            return
        if not a.children and not b.children:
            self._pairs(np.repeat(a.members, len(b.members)), np.tile(b.members, len(a.members)))
        elif a.children:
            for child in a.children:
                self._between(child, b)
        else:
            for child in b.children:
                self._between(a, child)

    def _pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of sets not compared before, by the bounds of their own bitmaps and sizes, then on the sets."""
        if self.side is None:
            i, j = np.minimum(i, j), np.maximum(i, j)
        else:
            across = self.side[i] != self.side[j]  # pairs of one block are compared in its own task
            i, j = i[across], j[across]
            i, j = np.where(self.side[i], j, i), np.where(self.side[i], i, j)
        new = ~self.compared[self.place[i], self.place[j]]
        i, j = i[new], j[new]
        self.compared[self.place[i], self.place[j]] = True
        both = self.sizes[i] + self.sizes[j]
        most = np.bitwise_count(self.bits[i] & self.bits[j]).sum(axis=1) + np.minimum(self.excess[i], self.excess[j])
        most = np.minimum(most, np.minimum(self.sizes[i], self.sizes[j]))
        able = most * (100 + self.percent) >= self.percent * both
        i, j = i[able], j[able]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
            self._verify(int(i[own[0]]), j[own])

    def _verify(self, i: int, others: np.ndarray) -> None:
        self.mark[self.local[i]] = 1
        sizes = self.sizes[others]
        held = self.mark[np.concatenate([self.local[j] for j in others.tolist()])]
        common = np.add.reduceat(held, np.cumsum(sizes) - sizes)
        self.mark[self.local[i]] = 0
        linked = others[100 * common >= self.percent * (self.sizes[i] + sizes - common)]
        self.degree[i] += self.weights[linked].sum()
        self.degree[linked] += self.weights[i]
        self.links += [(i, j) for j in linked.tolist() if self.union.join(i, j)]


def candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that share first shingles, also through others."""
    # A frequent shingle is dealt over SALTS tasks and counts as shared.
    salt = F.when(F.col("pos") >= F.col("plain"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    head = reps.select("doc_id", "n_shingles", "plain", F.posexplode("prefix").alias("pos", "h")).select(
        "doc_id", "n_shingles", "h", salt.cast("int").alias("salt")).repartition("h", "salt")
    by_shingle = W.partitionBy("h", "salt").orderBy("doc_id")
    beside = (F.col("salt") > 0) | F.coalesce(
        F.lag("doc_id").over(by_shingle), F.lead("doc_id").over(by_shingle)).isNotNull()
    shared = store(head.withColumn("beside", beside).filter("beside").drop("beside"), "shared-shingles")
    # A partner has at least `percent` of this size, so both look at enough shingles to share this many.
    least = F.floor(F.ceil(F.col("n_shingles") * percent / 100) / 10) + 1
    enough = shared.groupBy("doc_id", "n_shingles").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # Of the shared shingles the rarest come first now; without the last `least - 1` of them two similar sets still
    # share one, while what only common passages share falls away.
    held = shared.join(enough.select("doc_id", "n", least.alias("least")), "doc_id")
    number = shared.groupBy("h").agg(F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("documents", "h"))
    rare = held.join(number, "h").withColumn("place", place).filter(
        F.col("place") <= F.col("n") - F.col("least") + 1)
    first = F.first("doc_id").over(by_shingle.rowsBetween(W.unboundedPreceding, W.currentRow))
    stars = store(rare.select("h", "salt", "doc_id").repartition("h", "salt").select(
        "h", "salt", first.alias("a"), F.col("doc_id").alias("b")).filter("a <> b or salt > 0"), "stars")
    # The first classes of a shingle's salts, at most SALTS, are linked as well.
    firsts = stars.filter("a = b").select("h", F.min("b").over(W.partitionBy("h")).alias("a"), "b")
    return components(stars.select("a", "b").union(firsts.select("a", "b")).filter("a <> b").distinct())


def _tasks(groups: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Where each class goes: its group, and blocks i and j of it, of which `half` is its own.

    Large groups are cut into blocks by hash, and go in pairs of them.
    """
    members = groups.join(classes.withColumnRenamed("rep", "node"), "node")
    sizes = groups.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / (block * BLOCK_SHINGLES)))
    cut = members.join(sizes, "component").withColumn("blocks", blocks.cast("int"))
    own = F.pmod(F.xxhash64("node", *SAME), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    return cut.select(F.col("node").alias("doc_id"), *SAME, "weight", "component", own.alias("half"),
                      F.explode(pairs).alias("pair")).select(
        "doc_id", *SAME, "weight", "component", "pair.i", "pair.j", "half")


def verified_links(documents: DataFrame, tasks: DataFrame, late, percent: int) -> DataFrame:
    """Links (a, b) between classes, within a task no more than connect its sets; and for each class a row of a = b, its
    fingerprints and the number of rows it is linked with in a task."""
    def sets(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s = _ordered(shingle_sets(part.column("text")), late.value)
                prints = _prints(s)
                yield {"doc_id": part.column("doc_id"), "print1": prints[0], "print2": prints[1],
                       "n_shingles": np.diff(s.bounds), "shingles": pa.Array.from_buffers(
                           pa.binary(), len(part), [None, pa.py_buffer((8 * s.bounds).astype(np.int32)),
                                                    pa.py_buffer(s.hashes.tobytes())])}

    nodes = tasks.select("doc_id").distinct()
    wanted = documents.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    made = arrow_map(wanted, sets, "doc_id long, print1 long, print2 long, n_shingles long, shingles binary")
    key = ["component", "i", "j"]
    dealt = made.join(tasks, ["doc_id", *SAME]).repartition(*key).sortWithinPartitions(*key)
    columns = [*key, "doc_id", *SAME, "weight", "half", "shingles"]

    def run(batches):
        held, last = {}, None

        def links():
            names, halves = list(held), None if last[1] == last[2] else np.array([r[1] for r in held.values()])
            group = _Group([np.frombuffer(r[2], np.uint64) for r in held.values()],
                           np.array([r[0] for r in held.values()]), percent, halves)
            group.run()
            found = np.flatnonzero(group.degree).tolist()
            none = [None] * len(group.links)
            rows = [names[i] for i in found]
            return {"a": [names[i][0] for i, _ in group.links] + [r[0] for r in rows],
                    "b": [names[j][0] for _, j in group.links] + [r[0] for r in rows],
                    **{c: none + [r[k] for r in rows] for k, c in enumerate(SAME, start=1)},
                    "n": none + group.degree[found].tolist()}

        for batch in batches:
            for *values, shingles in zip(*(batch.column(c).to_pylist() for c in columns)):
                if values[:3] != last:
                    if len(held) > 1:
                        yield links()
                    held, last = {}, values[:3]
                # Equal rows of one doc_id are one class, whose weight has counted them.
                held[tuple(values[3:7])] = (*values[7:], shingles)
        if len(held) > 1:
            yield links()

    return arrow_map(dealt, run, LINKS)


def near_duplicates(documents: DataFrame, *, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each document."""
    late = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents))
    known = sketches(documents, late, percent)
    filled = known.filter("n_shingles > 0 and doc_id is not null")
    classes = store(filled.groupBy(*SAME).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    reps = filled.join(classes.select(*SAME, F.col("rep").alias("doc_id")), [*SAME, "doc_id"], "left_semi")
    groups = store(candidate_groups(reps.select("doc_id", "n_shingles", "plain", "prefix"), percent), "candidates")
    links = store(verified_links(documents, _tasks(groups, classes, block), late, percent), "verified-links")
    degrees = links.filter("n is not null").groupBy(F.col("a").alias("rep"), *SAME).agg(F.sum("n").alias("others"))
    counted = classes.join(degrees, ["rep", *SAME], "left").select(
        "rep", *SAME, (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    own = known.select("doc_id", *SAME).join(counted, SAME, "left")
    # Rows of one doc_id with different sets are one node.
    joined = links.filter("a <> b").select("a", "b").union(
        own.filter("rep is not null and doc_id <> rep").select("doc_id", "rep"))
    found = components(joined)
    return own.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
