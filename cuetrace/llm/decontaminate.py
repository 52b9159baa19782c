"""Benchmark passages in documents, found by spaced seeds and verified around each hit.

A seed is a mask: word positions that must agree, with positions between that may differ. The hashes of the
masked words of all benchmark items are kept in a table, and every position of every document is looked up. A hit
fixes how item and document are aligned; they overlap there if some `WINDOW` consecutive aligned words
differ in at most `SUBSTITUTIONS`. Masks are chosen so that every such overlap has a hit: whichever positions
of a window differ, some mask placed somewhere in it avoids them. An item of `LEAST_WORDS` to `WINDOW` words must appear
whole, with proportionally fewer substitutions, and has masks of its own. A still shorter one says nothing about
where a text comes from (`Yes.` is in many): it is not searched for, and `short_items` reports it.

Words are runs of letters and digits, ASCII punctuation set aside, A-Z in lower case. The benchmark is taken in
blocks of about `BLOCK_WORDS` words, each of which meets all documents, so the broadcast is bounded.

Null or empty texts and items have no words and no overlaps. Equal items are found each. Rows with equal
doc_id are searched each by itself. Extra columns are carried along by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.llm.jobs import arrow_map
from cuetrace.llm.words import PUNCTUATION, SPACE, chunks, grams, words_of

WINDOW = 13
LEAST_WORDS = 4
SUBSTITUTIONS = 2
WEIGHT = 6
MAX_MASKS = 6
BLOCK_WORDS = 200_000
SLOT_BITS = 20

OVERLAPS = "doc_id long, item_id long, start long, item_start long, n_words long, n_same long"


@lru_cache(maxsize=64)
def choose_masks(window: int, substitutions: int, weight: int = WEIGHT) -> list[tuple[int, ...]]:
    """Few masks of the greatest weight up to `weight` such that no choice of substitutions hits all placements."""
    wrong = [frozenset(c) for c in combinations(range(window), substitutions)]
    for w in range(min(weight, window - substitutions), 0, -1):
        options = {}
        for span in range(w, window + 1):
            for inner in combinations(range(1, span - 1), max(0, w - 2)):
                mask = (0, *inner, span - 1) if w > 1 else (0,)
                places = [frozenset(p + i for p in mask) for i in range(window - mask[-1])]
                options[mask] = {k for k, bad in enumerate(wrong) if any(not bad & place for place in places)}
        left, chosen = set(range(len(wrong))), []
        while left and len(chosen) < MAX_MASKS:
            best = max(options, key=lambda m: (len(options[m] & left), -m[-1]))
            if not options[best] & left:
                break
            chosen.append(best)
            left -= options[best]
        if not left:
            return chosen
    return [(0,)]


def allowed(window: int) -> int:
    return window * SUBSTITUTIONS // WINDOW


@dataclass
class SeedTable:
    """Items' words, and for each mask the sorted hashes of their seeds."""

    item_ids: list[int]
    words: np.ndarray
    bounds: np.ndarray
    masks: list[tuple[int, ...]]
    hashes: list[np.ndarray]
    places: list[np.ndarray]  # positions in `words`
    slots: list[np.ndarray]  # which hashes can be there, by their highest bits

    @classmethod
    def of(cls, item_ids: list[int], texts: list[str], least_words: int = LEAST_WORDS) -> SeedTable:
        w = words_of(pa.array(texts, pa.string()), lower=True, separators=SPACE + PUNCTUATION)
        bounds = w.bounds()
        sizes = np.minimum(np.diff(bounds), WINDOW)
        sizes[sizes < least_words] = 0
        table = cls(item_ids, w.hashes, bounds, [], [], [], [])
        for size in sorted({int(s) for s in sizes if s}):
            for mask in choose_masks(size, allowed(size)):
                hashes = grams(w.hashes, list(mask))
                at = np.arange(len(hashes))
                at = at[(sizes[w.doc[at]] == size) & (w.doc[at] == w.doc[at + mask[-1]])]
                order = np.argsort(hashes[at], kind="stable")
                slots = np.zeros(1 << SLOT_BITS, bool)
                slots[hashes[at] >> np.uint64(64 - SLOT_BITS)] = True
                table.masks.append(mask)
                table.hashes.append(hashes[at][order])
                table.places.append(at[order])
                table.slots.append(slots)
        return table

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, start in the document, start in the item, words, equal words) of each overlapping pair."""
        w = words_of(column, lower=True, separators=SPACE + PUNCTUATION)
        bounds = w.bounds()
        found = []
        for mask, hashes, places, slots in zip(self.masks, self.hashes, self.places, self.slots):
            seeds = grams(w.hashes, list(mask))
            at = np.flatnonzero(slots[seeds >> np.uint64(64 - SLOT_BITS)])
            at = at[w.doc[at] == w.doc[at + mask[-1]]]
            low, high = (np.searchsorted(hashes, seeds[at], side) for side in ("left", "right"))
            n = high - low
            at, low = np.repeat(at, n), np.repeat(low, n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            place = places[low + nth]
            item = np.searchsorted(self.bounds, place, "right") - 1
            found.append(np.stack([w.doc[at], item, at - place], axis=1))
        if not found or not sum(map(len, found)):
            return
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for row, item, shift in np.unique(np.concatenate(found), axis=0).tolist():
            overlap = self._overlap(w.hashes, bounds[row], bounds[row + 1], item, shift)
            if overlap and overlap > best.get((row, item), (-1,)):
                best[row, item] = overlap
        for (row, item), (same, start, item_start, size) in sorted(best.items()):
            yield row, item, -start, -item_start, size, same

    def _overlap(self, words, doc_begin, doc_end, item, shift):
        """The best window of item and document when item word p meets document word p + shift."""
        begin, end = int(self.bounds[item]), int(self.bounds[item + 1])
        size = min(end - begin, WINDOW)
        low, high = max(begin, int(doc_begin) - shift), min(end, int(doc_end) - shift)
        if high - low < size:
            return None
        same = np.concatenate([[0], np.cumsum(self.words[low:high] == words[low + shift:high + shift])])
        inside = same[size:] - same[:-size]
        at = int(np.argmax(inside))
        if inside[at] < size - allowed(size):
            return None
        return int(inside[at]), -(low + at + shift - int(doc_begin)), -(low + at - begin), size


def _n_words(text: Column) -> Column:
    """Number of words, as the search cuts them."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D!-/:-@\[-`{-~]+"), lambda w: w != ""))


def short_items(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that are too short to be searched for; a null text has no words."""
    words = F.coalesce(_n_words(F.col("text")), F.lit(0)).alias("n_words")
    return benchmark.select("item_id", words).filter(F.col("n_words") < least_words)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> Iterator[SeedTable]:
    """Tables of the benchmark's items, each of about `block_words` words."""
    items = benchmark.select("item_id", "text").filter(_n_words(F.col("text")) >= least_words)
    words = items.agg(F.sum(_n_words(F.col("text")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        if rows:
            yield SeedTable.of([r["item_id"] for r in rows], [r["text"] for r in rows], least_words)


def overlaps(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """Each document and item that overlap, with the best window."""
    context = documents.sparkSession.sparkContext
    result = None
    for table in blocks(benchmark, block_words, least_words):
        shared = context.broadcast(table)

        def run(batches, shared=shared):
            table = shared.value
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = list(table.search(part.column("text")))
                    ids = part.column("doc_id").to_pylist()
                    if rows:
                        yield {"doc_id": [ids[r[0]] for r in rows], "item_id": [table.item_ids[r[1]] for r in rows],
                               "start": [r[2] for r in rows], "item_start": [r[3] for r in rows],
                               "n_words": [r[4] for r in rows], "n_same": [r[5] for r in rows]}

        found = arrow_map(documents.select("doc_id", "text"), run, OVERLAPS)
        result = found if result is None else result.unionByName(found)
    return documents.sparkSession.createDataFrame([], OVERLAPS) if result is None else result


def clean(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS,
          least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without an overlap; nothing is joined, each task drops its own rows."""
    context = documents.sparkSession.sparkContext
    for table in blocks(benchmark, block_words, least_words):
        shared = context.broadcast(table)

        def run(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in shared.value.search(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
