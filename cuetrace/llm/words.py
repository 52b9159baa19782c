"""Words, shingles and their 64-bit hashes of a whole Arrow column at once, in numpy.

Words are maximal runs of bytes that are no separator. The separators are ASCII, so UTF-8 texts
can be cut as bytes. A word's hash is a polynomial over its bytes, taken as a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
CHUNK_BYTES = 1 << 18  # its temporary arrays fit the CPU's caches and are small beside the worker
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass
class Words:
    """Words of a few documents: byte positions in `data`, document numbers and hashes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    prefix: np.ndarray

    def bounds(self) -> np.ndarray:
        """Number of the first word of each document, and the number of all words."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans."""
        return mix((self.prefix[ends] - self.prefix[starts]) * _powers(len(self.prefix))[1][starts])


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `size` bytes of text, or one document."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of_two_size(max(1 << 12, 1 << int(n).bit_length()))


@lru_cache(maxsize=2)
def _powers_of_two_size(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (BASE, INVERSE):
        values = np.full(n, base, np.uint64)
        values[0] = 1
        both.append(np.multiply.accumulate(values))
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits, one-to-one."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_of(column: pa.Array, *, lower: bool = False, separators: bytes = SPACE) -> Words:
    data, offsets = text_bytes(column)
    n = len(data)
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    apart = apart[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    inside = ~apart
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= apart[:-1] | begins[1:-1]
        last[:-1] &= apart[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters = data
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        letters = fold[data]
    powers, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    return Words(data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes, prefix)


def grams(hashes: np.ndarray, places: list[int]) -> np.ndarray:
    """Hash of the words at i + place for every i at which all places lie in `hashes`."""
    n = len(hashes) - max(places)
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(len(places)))
    for place in places:
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[place:place + n]
        total ^= total >> np.uint64(29)
    return mix(total)
