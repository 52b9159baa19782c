"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A window is `WINDOW` consecutive words. Windows that equal one another choose the same anchor, the
phrase of `PHRASE` words with the smallest hash in them, so a window can recur only if its anchor's phrase does:

1. the anchors of all documents are brought together by hash; those that occur once are dropped;
2. around the others, segments are cut: the windows that share an anchor, 20 to 34 words;
3. segments with equal text are merged to one with its first place and count, before they are shuffled;
4. shards of anchors compile automata. A shard confirms the windows that several of its segments have, writes each
   as four letters of five words, and streams these segments through the automaton, in five phases. Each
   occurrence is checked word by word and compared with the window's first place in the corpus;
   Anchors with more than `HOT_SEGMENTS` distinct segments, as the edges of a passage in very many documents have, go
   into no shard. Their windows are compared by hash on Spark, the first places and counts combined before the shuffle;
5. windows that started earlier are removed: all of a segment's later copies, and those marked in its first place.

A null or empty text has no words. Rows with equal doc_id are ordered by their texts' hashes; equal rows are treated
alike, as one. Rows with a null doc_id are left as they are and repeat nothing. Extra columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from cuetrace.llm.jobs import arrow_map, drop_stored, store
from cuetrace.llm.words import Words, chunks, grams, words_of

WINDOW = 20
PHRASE = 6
LETTER = 5  # words
SHARD_SEGMENTS = 20_000
HOT_SEGMENTS = 5_000  # of an anchor
DOC = ["doc_id", "text_hash"]

ANCHORS = "doc_id long, text_hash long, anchor int, h long"
SEGMENTS = "h long, doc_id long, text_hash long, start int, n_windows int, words string"
WINDOWS = "h long, window long, doc_id long, text_hash long, start int"
MARKS = "doc_id long, text_hash long, starts array<int>"
KEPT = "doc_id long, text_hash long, n_words long, n_removed long, kept string"


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, its anchor's first word, and the hashes of all phrases."""
    phrases = grams(w.hashes, list(range(PHRASE)))
    n = len(w.hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), phrases
    first = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1:])
    nearest = sliding_window_view(phrases, WINDOW - PHRASE + 1)[first].argmin(axis=1)
    return first, first + nearest, phrases


def anchors(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words_of(part.column("text"))
                _, anchor, phrases = _anchors(w)
                anchor = np.unique(anchor)
                rows = pa.array(w.doc[anchor])
                yield {"doc_id": part.column("doc_id").take(rows), "text_hash": part.column("text_hash").take(rows),
                       "anchor": anchor - w.bounds()[w.doc[anchor]], "h": phrases[anchor].view(np.int64)}

    return arrow_map(documents, run, ANCHORS)


def recurring(found: DataFrame) -> DataFrame:
    """The anchors whose phrase occurs again, by document."""
    often = store(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "phrases")
    return found.join(often, "h", "left_semi").groupBy(*DOC).agg(F.collect_set("anchor").alias("anchors"))


def segments(documents: DataFrame) -> DataFrame:
    """From doc_id, text_hash, text and anchors: a row for each anchor, with the words of its windows."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words_of(part.column("text"))
                first, anchor, phrases = _anchors(w)
                lists = part.column("anchors")
                here = w.bounds()[np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))]
                wanted = np.zeros(len(w.hashes) + 1, bool)
                wanted[here + lists.flatten().to_numpy()] = True
                keep = wanted[anchor]
                first, anchor = first[keep], anchor[keep]
                begins = np.flatnonzero(np.diff(anchor, prepend=-1))
                if not len(begins):
                    continue
                counts = np.diff(np.append(begins, len(anchor)))
                at, anchor = first[begins], anchor[begins]
                doc = w.doc[at]
                raw = w.data.tobytes()
                texts = [b" ".join(raw[a:b].split()).decode() for a, b in zip(
                    w.starts[at].tolist(), w.ends[at + counts + WINDOW - 2].tolist())]
                rows = pa.array(doc)
                yield {"h": phrases[anchor].view(np.int64), "doc_id": part.column("doc_id").take(rows),
                       "text_hash": part.column("text_hash").take(rows), "start": at - w.bounds()[doc],
                       "n_windows": counts, "words": texts}

    return arrow_map(documents, run, SEGMENTS)


def repeats_in_shard(texts: pa.Array, places: np.ndarray) -> dict[int, list[int]]:
    """For each distinct segment, the starts of windows in its first place that begin earlier elsewhere.

    `places`: rows (doc_id, text_hash, start) of each segment's first place.
    """
    w = words_of(texts)
    bounds = w.bounds()
    windows, letters = grams(w.hashes, list(range(WINDOW))), grams(w.hashes, list(range(LETTER)))
    at = np.arange(len(windows))
    at = at[w.doc[at] == w.doc[at + WINDOW - 1]]
    _, example, which, times = np.unique(windows[at], return_index=True, return_inverse=True, return_counts=True)
    # Windows of one segment alone start first in its first place.
    shared = times > 1
    example = at[example[shared]]
    if not len(example):
        return {}
    _, letter = np.unique(letters, return_inverse=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    steps = np.arange(0, WINDOW, LETTER)
    for number, key in enumerate(map(tuple, letter[example[:, None] + steps].tolist())):
        automaton.add_word(key, number)
    automaton.make_automaton()

    found_at, found_pattern = [], []
    letter = letter.tolist()
    for number in np.unique(w.doc[at[shared[which]]]).tolist():
        begin, end = int(bounds[number]), int(bounds[number + 1]) - LETTER + 1
        for phase in range(begin, min(begin + LETTER, end)):
            for last, pattern in automaton.iter(tuple(letter[phase:end:LETTER])):
                found_at.append(phase + LETTER * (last - len(steps) + 1))
                found_pattern.append(pattern)
    found, pattern = np.array(found_at), np.array(found_pattern)
    raw = w.data.tobytes()
    own, other = (zip(w.starts[i].tolist(), w.ends[i + WINDOW - 1].tolist()) for i in (found, example[pattern]))
    same = np.fromiter((raw[a:b] == raw[c:d] for (a, b), (c, d) in zip(own, other)), bool, len(found))
    found, pattern = found[same], pattern[same]
    number = w.doc[found]
    place = places[number]
    place[:, 2] += found - bounds[number]
    order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], pattern))
    pattern, place, number = pattern[order], place[order], number[order]
    first = np.searchsorted(pattern, pattern)
    later = (place != place[first]).any(axis=1)
    repeats: dict[int, list[int]] = {}
    for i, start in zip(number[later].tolist(), place[later, 2].tolist()):
        repeats.setdefault(i, []).append(start)
    return repeats


def marks(distinct: DataFrame) -> DataFrame:
    """Windows to remove in the segments' first places. A shard holds whole anchors."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def shard(rows: pa.Table):
            places = np.stack([rows.column(c).to_numpy() for c in (*DOC, "start")], axis=1).astype(np.int64)
            found = repeats_in_shard(rows.column("words").combine_chunks(), places)
            at = list(found)
            return {"doc_id": places[at, 0], "text_hash": places[at, 1], "starts": list(found.values())}

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SHARD_SEGMENTS:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield shard(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield shard(pa.Table.from_batches(held))

    return arrow_map(distinct.repartition("h").sortWithinPartitions("h"), run, MARKS)


def hot_anchors(distinct: DataFrame) -> DataFrame:
    """The anchors with too many distinct segments for a shard."""
    return store(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > HOT_SEGMENTS).select("h"), "hot-anchors")


def marks_of_hot(distinct: DataFrame) -> DataFrame:
    """As `marks`, row by row: the windows are known by the hashes of anchor and window."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "words"):
                w = words_of(part.column("words"))
                windows = grams(w.hashes, list(range(WINDOW)))
                at = np.arange(len(windows))
                at = at[w.doc[at] == w.doc[at + WINDOW - 1]]
                rows = w.doc[at]
                start = part.column("start").to_numpy()[rows] + at - w.bounds()[rows]
                yield {"window": windows[at].view(np.int64), "start": start,
                       **{c: part.column(c).take(pa.array(rows)) for c in ("h", *DOC)}}

    windows = arrow_map(distinct, run, WINDOWS)
    key, place = ["h", "window"], F.struct(*DOC, "start")
    shared = store(windows.groupBy(*key).agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1").select(*key, "earliest"), "shared-windows")
    return windows.join(shared, key).filter(place != F.col("earliest")).select(*DOC, F.array("start").alias("starts"))


def _plain(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [(text or "").encode().split() for text in part.column("text").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"),
                       "n_words": [len(x) for x in words], "n_removed": [0] * len(words),
                       "kept": [b" ".join(x).decode() for x in words]}

    return arrow_map(documents, run, KEPT)


def _without(documents: DataFrame) -> DataFrame:
    """From doc_id, text_hash, text, spans (start, windows) and starts: the words left."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                out = {name: [] for name in ("n_words", "n_removed", "kept")}
                for text, spans, starts in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "starts"))):
                    words = (text or "").encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    for span in spans or []:
                        change[span["start"]] += 1
                        change[span["start"] + span["n_windows"] + WINDOW - 1] -= 1
                    for start in (s for part_ in starts or [] for s in part_):
                        change[start] += 1
                        change[start + WINDOW] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(len(words) - keep.sum()))
                    out["kept"].append(b" ".join(x for x, k in zip(words, keep.tolist()) if k).decode())
                yield {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), **out}

    return arrow_map(documents, run, KEPT)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the words kept, joined by one space."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = anchors(docs.filter(F.col("doc_id").isNotNull()))
    hits = store(recurring(found), "anchors")
    known = store(docs.join(hits, DOC, "left"), "documents")
    touched = known.filter("anchors is not null")
    cut = store(segments(touched).withColumn("words_hash", F.xxhash64("words")), "segments")
    place = F.struct(*DOC, "start")
    distinct = store(cut.groupBy("h", "words_hash").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words")), "distinct")
    firsts, hot = distinct.select("h", "first.*", "words"), hot_anchors(distinct)
    in_first = marks(firsts.join(hot, "h", "left_anti")).unionByName(marks_of_hot(firsts.join(hot, "h", "left_semi")))
    later = (cut.select("h", "words_hash", *DOC, "start", "n_windows")
             .join(distinct.filter("n > 1").select("h", "words_hash", "first"), ["h", "words_hash"])
             .filter(place != F.col("first")))
    removed = store(later.groupBy(*DOC).agg(F.collect_set(F.struct("start", "n_windows")).alias("spans")).join(
        in_first.groupBy(*DOC).agg(F.collect_list("starts").alias("starts")), DOC, "full"), "removed")
    drop_stored(cut, distinct, hits)
    changed = _without(touched.select(*DOC, "text").join(removed, DOC, "left").select(*DOC, "text", "spans", "starts"))
    rest = _plain(known.filter("anchors is null").select(*DOC, "text"))
    return rest.unionByName(changed).select("doc_id", "n_words", "n_removed", "kept")
