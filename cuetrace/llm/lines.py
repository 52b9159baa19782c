"""Removal of lines that many documents hold, by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z in lower case; keys of at
least `MIN_CHARS` code points count. Documents arrive in batches. A batch's keys are merge-joined with
the runs kept so far: keys that no run has (anti join) become a new run, known keys only update their
documents. So no key is in two runs. Runs are stored sorted by hash; when a level has `FANOUT` of them, they are
compacted into one run of the next level. At the end a key's documents and largest doc_id are those of its run
and of its updates.

A null or empty text is one empty line. Rows with equal doc_id are one document for the count, and
each keeps its own row. Rows with a null doc_id never count and keep all lines. Only DataFrame
functions are used. Extra columns are carried along, but for
older `n_lines` and `n_dropped`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.workspace import materialize

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Runs of (hash, documents, largest doc_id) by level, each stored and sorted by hash; no hash is in two runs.

    What later batches say of a hash that a run has is stored beside the runs, as updates.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []

    def _store(self, run: DataFrame, level: int) -> DataFrame:
        return materialize(run.sortWithinPartitions(*HASH), f"line-run-{level}")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id), whose documents are in no other batch."""
        own = batch.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if known := self.runs():
            own = materialize(own, "line-batch")
            seen = _union(known).select(*HASH)
            self.updates.append(materialize(own.join(seen, HASH, "left_semi"), "line-updates"))
            own = own.join(seen, HASH, "left_anti")
        run, level = self._store(own, 0), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._store(_union(self.levels[level]).repartition(*HASH), level + 1)
            self.levels[level] = []
            level += 1

    def totals(self) -> DataFrame:
        """Documents and largest doc_id of every hash."""
        return _union([*self.runs(), *self.updates]).groupBy(*HASH).agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _without(lines: Column, dropped: Column) -> Column:
    """The lines whose places are not in `dropped`, in time that grows with the number of lines."""
    # Held in a variable, the text is split once and the places are hashed once.
    return F.transform(F.array(lines), lambda held: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(held) - 1), dropped), lambda i: F.get(held, i)))[0]


def dedup_lines(documents: DataFrame, *, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                batches: int = BATCHES) -> DataFrame:
    """The documents with the texts left, and `n_lines`, `n_dropped`."""
    text_hash = F.xxhash64("text").alias("text_hash")
    # The hash stands below the explode: beside it, the whole text would be hashed again for each of its lines.
    whole = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", text_hash, "text")
    line = whole.select("doc_id", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    keyed = line.select("doc_id", "text_hash", "line_no", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars)
    keys = materialize(keyed.select("doc_id", "text_hash", "line_no", *_hashes(F.col("key")),
                                    F.pmod(F.hash("doc_id"), F.lit(batches)).alias("batch")), "line-keys",
                       partition_by=["batch"])
    runs = LineRuns()
    for number in range(batches):
        runs.add(keys.filter(F.col("batch") == number).select(*HASH, "doc_id"))
    frequent = materialize(runs.totals().filter(F.col("n_docs") >= min_documents).select(*HASH, "last_doc"),
                           "frequent-lines")
    dropped = (keys.select("doc_id", "text_hash", "line_no", *HASH).join(frequent, HASH)
               .filter(F.col("doc_id") != F.col("last_doc")).groupBy("doc_id", "text_hash")
               .agg(F.collect_set("line_no").alias("drop_lines")))
    added = ("n_lines", "n_dropped")
    others = [c for c in documents.columns if c not in ("doc_id", "text", *added)]
    rows = documents.select("doc_id", "text", text_hash, F.struct(F.lit(0), *others).alias("others"))
    left = rows.join(dropped, ["doc_id", "text_hash"], "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("drop_lines").isNull(), lines).otherwise(_without(lines, F.col("drop_lines")))
    return left.select("doc_id", F.array_join(kept, "\n").alias("text"), *[F.col(f"others.`{c}`") for c in others],
                       F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce(F.size("drop_lines"), F.lit(0)).cast("long").alias("n_dropped"))
