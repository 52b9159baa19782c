"""Token ids of whole texts by a byte-level BPE tokenizer of the tokenizers library.

Such a tokenizer never merges across the start of a run of white space that follows other text.
Texts are cut before these runs; a chunk is looked up by its 64-bit hash, and encoded where it is
new to the Python worker. Memory is bounded by the size of a part, the chunks' table and the bytes of the pieces' cache.

As in the library, the string of a special token in a text gives that token's id. With `special_as_text` such
strings are ordinary text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from cuetrace.llm.words import chunks, words_of

# The pattern that a byte-level tokenizer with `use_regex` cuts by (fixed values).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# White space beyond ASCII joins runs across the cuts; texts with it are encoded in one piece.
SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER_SPACE = regex.compile("[" + "".join(map(chr, SPACES)) + "]")
CACHE_BYTES = 8 << 20
ENTRY_BYTES = 170  # of an entry beside its text and ids
SLOT_BITS = 21  # 16 bytes a slot
MOST_CHUNKS, MOST_IDS = 5 << 18, 5 << 20  # in the chunks' table
KEPT_BYTES = 64  # of the longest chunk or piece that is kept


def _letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Takes short entries until it is full."""

    left = CACHE_BYTES

    def keep(self, key, size: int, ids: bytes) -> None:
        cost = ENTRY_BYTES + size + len(ids)
        if size <= KEPT_BYTES and cost <= self.left:
            self.left -= cost
            self[key] = ids


class _Table:
    """Ids of chunks by 64-bit hash, in arrays (open addressing): all chunks of a part are looked up at once.

    It takes chunks until it is full. The ids lie one chunk after the other in `flat`; behind them is room for the
    ids of chunks that are not kept, which the next part overwrites.
    """

    def __init__(self):
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)  # 0: free
        self.begins, self.counts = (np.zeros(1 << SLOT_BITS, np.int32) for _ in range(2))
        self.flat = np.zeros(1 << 16, "<u4")
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each hash begin in `flat`, or -1, and their number."""
        slot = self._home(hashes)
        there = self.keys[slot]
        new = there == 0
        on = np.flatnonzero((there != hashes) & ~new)
        while len(on):
            slot[on] = self._after(slot[on])
            there = self.keys[slot[on]]
            new[on] = there == 0
            on = on[(there != hashes[on]) & (there != 0)]
        return np.where(new, -1, self.begins[slot]), self.counts[slot]

    def write(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids of chunks behind those that are kept."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = self.used + np.cumsum(counts) - counts
        end = self.used + int(counts.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(end + end // 4 - self.used, "<u4")])
        self.flat[self.used:end] = np.frombuffer(b"".join(ids), "<u4")
        return begins, counts

    def keep(self, hashes: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        """Keep the first chunks just written, as many as there is room for; their hashes are new and distinct."""
        n = min(len(hashes), MOST_CHUNKS - self.n, int(np.searchsorted(begins + counts, MOST_IDS, "right")))
        if n <= 0:
            return
        self.n, self.used = self.n + n, int(begins[n - 1] + counts[n - 1])
        slot, on = self._home(hashes[:n]), np.arange(n)
        while len(on):
            free = on[self.keys[slot[on]] == 0]
            self.keys[slot[free]] = hashes[free]  # of several for one slot the last stays
            got = free[self.keys[slot[free]] == hashes[free]]
            self.begins[slot[got]], self.counts[slot[got]] = begins[got], counts[got]
            on = on[self.keys[slot[on]] != hashes[on]]
            slot[on] = self._after(slot[on])

    @staticmethod
    def _home(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _after(slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << SLOT_BITS) - 1


class Encoder:
    """Little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        setup = json.loads(self.tokenizer.to_str())
        before = setup["pre_tokenizer"] or {}
        # Words may be given to the model directly only if nothing else is set up.
        self.direct = (setup["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
                       and not before.get("add_prefix_space"))
        # The library looks for these in the whole text before it cuts it.
        self.added = [t["content"] for t in setup["added_tokens"] if not (special_as_text and t["special"])]
        self.letters = _letters()
        self.chunks, self.pieces = _Table(), _Cache()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            written = piece if piece[0] != " " else self.letters[0x20] + piece[1:]
        else:
            written = piece.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._ids(piece)
            self.pieces.keep(piece, len(piece), ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if not self.direct:
            return self.encode(chunk)
        # Words, and words before a comma or full stop, are most chunks; they need no pattern.
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return self._ids(chunk)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return self._piece(chunk[:-1]) + self._piece(chunk[-1])
        return b"".join(map(self._piece, PIECES.findall(chunk)))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin; null counts as empty."""
        w = words_of(column)
        known = w.bounds()
        filled = np.flatnonzero(known[1:] > known[:-1])
        # A chunk begins where the word before ends; what follows a text's last word is one more chunk.
        starts = np.concatenate([w.offsets[:1], w.ends[:-1]]) if len(w.ends) else w.ends
        starts[known[filled]] = w.offsets[filled]
        last = w.offsets[:-1].copy()
        last[filled] = w.ends[known[filled + 1] - 1]
        trailing = np.flatnonzero(last < w.offsets[1:])
        at = known[trailing + 1]
        starts = np.insert(starts, at, last[trailing])
        ends = np.insert(w.ends, at, w.offsets[trailing + 1])
        doc = np.insert(w.doc, at, trailing)

        hashes = np.maximum(w.span_hashes(starts, ends), np.uint64(1))
        begins, taken = self.chunks.find(hashes)
        new = np.flatnonzero(begins < 0)
        if len(new):
            new_hashes, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            first = new[first]
            sizes = (ends - starts)[first]
            order = np.argsort(sizes > KEPT_BYTES, kind="stable")  # the long ones, which are not kept, last
            raw = w.data.tobytes()
            found = [self._chunk(raw[a:b].decode()) for a, b in zip(starts[first[order]].tolist(),
                                                                   ends[first[order]].tolist())]
            new_begins, new_counts = self.chunks.write(found)
            n_short = int(np.count_nonzero(sizes <= KEPT_BYTES))
            self.chunks.keep(new_hashes[order[:n_short]], new_begins[:n_short], new_counts[:n_short])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            begins[new], taken[new] = new_begins[place[which]], new_counts[place[which]]
        ids = self.chunks.flat[np.repeat(begins - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())]
        per_doc = np.bincount(doc, weights=taken, minlength=len(w.offsets) - 1).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_doc)])
        odd = {i for i in _with_wide_letters(w.data, w.offsets) if OTHER_SPACE.search(column[i].as_py())}
        for content in self.added:
            holds = pc.fill_null(pc.match_substring(column, content), False)
            odd.update(np.flatnonzero(holds.to_numpy(zero_copy_only=False)).tolist())
        if odd:
            parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
            for i in odd:
                parts[i] = np.frombuffer(self.encode(column[i].as_py()), "<u4")
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


def _with_wide_letters(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts with bytes by which white space beyond ASCII can begin."""
    rare = (data >= 0xE1) & (data <= 0xE3)
    rare[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(rare), "right") - 1).tolist()


@lru_cache(maxsize=1)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a Python worker, as tasks share its caches."""
    return Encoder(path, special_as_text)


def encoded(batch: pa.RecordBatch, text: str, path: str, special_as_text: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their ids and where each document's ids begin."""
    for part in chunks(batch, text):
        yield (part, *encoder(path, special_as_text).encode_column(part.column(text)))
