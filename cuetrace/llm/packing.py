"""Packing of documents into token sequences by counts of length combinations.

Every document is cut into pieces of `window` ids and a rest. The lengths' histogram over all
documents (at most `window` numbers) is all that the plan needs:

1. combinations of up to three lengths that fill the window are enumerated;
2. non-negative least squares finds how often each is used, so that together they use up the histogram;
3. the counts are rounded down to what the histogram still has;
4. what remains is packed greedily, best fit first; where nothing fits, a piece is cut to fill the window.

A plan is a list of placements (length, cut, first rank, count -> first sequence, offset). A piece finds
its own by its rank among the pieces of its length, so that no piece moves between tasks.

A null or empty text is the end id alone. Rows with equal doc_id are documents of their own; a null
doc_id stays null. Extra columns are ignored; no rows give no sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cuetrace.llm.jobs import arrow_map, store
from cuetrace.llm.tokens import encoded

WINDOW = 1024
END_ID = 0
SWEEPS = 8
SLICE = 512  # pieces that are placed at a time
RANKS = 42  # bits for a rank in a placement's key

PIECES = ("part int, doc_id long, start long, length int, ids binary, doc_tokens long, local_rank long")
PACKED = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Up to three lengths, in descending order, that fill the window."""
    have = set(lengths)
    found = [(window,)] if window in have else []
    found += [(window - a, a) for a in lengths if window - a >= a and window - a in have]
    for i, a in enumerate(lengths):  # ascending
        if 3 * a > window:
            break
        for b in lengths[i:]:
            c = window - a - b
            if c < b:
                break
            if c in have:
                found.append((c, b, a))
    return found


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """x >= 0 that makes the lengths used by the combinations closest to the histogram, by coordinate descent."""
    rest = [float(n) for n in histogram]
    x = [0.0] * len(combos)
    uses = [[(length, combo.count(length)) for length in set(combo)] for combo in combos]
    norm = [sum(k * k for _, k in use) for use in uses]
    for _ in range(sweeps):
        moved = 0.0
        for j, use in enumerate(uses):
            step = sum(k * rest[length] for length, k in use) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, k in use:
                    rest[length] -= k * step
        if moved < 0.5:
            break
    return x


@dataclass
class Plan:
    """Placements as columns, sorted by key = (length, begin of the cut, first rank)."""

    window: int
    keys: np.ndarray
    sizes: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    first_ranks: np.ndarray
    n_sequences: int

    def key(self, length, begin, rank):
        return (length * (self.window + 1) + begin << RANKS) + rank


class _Stock:
    """What is left: by length, runs of pieces (their whole length, begin of the part, first rank, count)."""

    def __init__(self, histogram: np.ndarray):
        self.runs = {n: [(n, 0, 0, int(c))] for n, c in enumerate(histogram.tolist()) if c}
        self.counts = {n: int(c) for n, c in enumerate(histogram.tolist()) if c}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        self.counts[length] -= n
        taken = []
        while n:
            whole, begin, rank, count = self.runs[length].pop()
            used = min(n, count)
            taken.append((whole, begin, rank, used))
            if count > used:
                self.runs[length].append((whole, begin, rank + used, count - used))
            n -= used
        if not self.counts[length]:
            del self.counts[length], self.runs[length]
        return taken

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs.setdefault(length, []).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[3]


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    stock, placed, base = _Stock(histogram), [], 0

    def place(lengths: list[int], n: int, cut: int | None = None) -> None:
        """Fill n sequences with these lengths, then with the first part of a piece of length `cut`."""
        nonlocal base
        offset = 0
        for length in lengths:
            at = base
            for whole, begin, rank, count in stock.take(length, n):
                placed.append((whole, begin, rank, length, at, offset))
                at += count
            offset += length
        if cut is not None:
            at, size = base, window - offset
            for whole, begin, rank, count in stock.take(cut, n):
                placed.append((whole, begin, rank, size, at, offset))
                stock.put(cut - size, (whole, begin + size, rank, count))
                at += count
        base += n

    lengths = sorted(stock.counts)
    combos = combinations(lengths, window)
    for combo, x in zip(combos, repeat_counts(histogram, combos)):
        n = min([int(x + 1e-6), *(stock.counts.get(length, 0) // combo.count(length) for length in combo)])
        if n:
            place(list(combo), n)
    while stock.counts:
        left = dict(stock.counts)
        chosen, space = [], window
        while fitting := [n for n, c in left.items() if c and n <= space]:
            chosen.append(max(fitting))
            left[chosen[-1]] -= 1
            space -= chosen[-1]
        cuttable = [n for n, c in left.items() if c and n > space]
        cut = max(cuttable) if space and cuttable else None
        n = min(stock.counts[m] // (chosen.count(m) + (m == cut)) for m in {*chosen, *([cut] if cut else [])})
        place(chosen, n, cut)
    whole, begin, rank, size, sequence, offset = np.array(placed, np.int64).reshape(-1, 6).T
    keys = (whole * (window + 1) + begin << RANKS) + rank
    order = np.argsort(keys)
    return Plan(window, keys[order], size[order], sequence[order], offset[order], rank[order], base)


def cut_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Every document's ids in pieces of at most `window`, with the rank among its task's pieces of that length."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for piece, ids, offsets in encoded(batch, "text", tokenizer):
                ids = np.insert(ids, offsets[1:], END_ID)
                n_tokens = np.diff(offsets) + 1
                n_pieces = -(-n_tokens // window)
                doc = np.repeat(np.arange(len(n_tokens)), n_pieces)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
                length = np.minimum(window, n_tokens[doc] - start)
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=window + 1)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - (np.cumsum(counts) - counts)[length[order]]
                rank += seen[length]
                seen += counts
                ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                yield {"part": np.full(len(doc), part), "doc_id": piece.column("doc_id").take(pa.array(doc)),
                       "start": start, "length": length,
                       "ids": pa.Array.from_buffers(pa.binary(), len(doc), [
                           None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4").tobytes())]),
                       "doc_tokens": n_tokens[doc], "local_rank": rank}

    return store(arrow_map(documents.select("doc_id", "text"), run, PIECES), "pieces")


def pack(documents: DataFrame, tokenizer: str, *, window: int = WINDOW) -> DataFrame:
    """One row a packed piece: its ids (little-endian, 32 bits), its sequence and its place there."""
    pieces = cut_pieces(documents, tokenizer, window)
    per_task = store(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[row["length"]] = row["n"]
    # Its size follows the number of lengths and of their combinations, not that of pieces.
    plan = documents.sparkSession.sparkContext.broadcast(make_plan(histogram, window))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(per_task.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids", "doc_tokens",
                           (F.col("before") + F.col("local_rank")).alias("rank"))

    def run(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at, begin = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(at):
                which = np.searchsorted(plan.value.keys, plan.value.key(length[at], begin, rank[at]), "right") - 1
                size, rows = plan.value.sizes[which], pa.array(at)
                ids = batch.column("ids").take(rows)
                if (size < length[at]).any():
                    ids = pa.array([x.as_buffer().slice(4 * b, 4 * s).to_pybytes() for x, b, s in
                                    zip(ids, begin.tolist(), size.tolist())], pa.binary())
                yield {"doc_id": batch.column("doc_id").take(rows),
                       "start": batch.column("start").to_numpy()[at] + begin, "length": size, "ids": ids,
                       "doc_tokens": batch.column("doc_tokens").take(rows),
                       "sequence_id": plan.value.sequences[which] + rank[at] - plan.value.first_ranks[which],
                       "offset": plan.value.offsets[which]}
                more = begin + size < length[at]
                at, begin = at[more], (begin + size)[more]

    return arrow_map(ranked, run, PACKED)
