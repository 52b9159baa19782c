"""Token ids of all documents in files of wavelet matrices.

A file holds the ids of consecutive documents. Its alphabet is the sorted set of ids that occur in
it; each id's place there is written as bits, one plane a bit, the highest first, and before each
further plane the positions are dealt stably by the bit of the plane before. A position can so be
followed through the planes with counts of set bits alone: `access` reads one id, `count` and `rank`
count an id, `select` finds its j-th occurrence, all without unpacking the file.

Rows with equal doc_id are documents of their own, in the order of their texts' hashes. A null text is empty;
a null doc_id comes first. Documents are never split over files, and extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cuetrace.llm.jobs import arrow_map
from cuetrace.llm.tokens import encoded
from cuetrace.workspace import materialize

END_ID = 0
FILE_TOKENS = 1 << 20
MAGIC = b"WVM1"
BLOCK = 512
NO_ID = np.iinfo(np.int64).min

FILES = ("part int, file int, first_doc long, n_docs long, n_tokens long, data binary")
SPANS = "part int, file int, row int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """The planes of one file, with rank and select on them."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], n: int):
        self.alphabet, self.n = alphabet, n
        self.planes = planes  # bits, eight in a byte

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        size = int(ids.max()) + 1 if len(ids) else 1
        used = np.zeros(size, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype("<u4")
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        code = (np.cumsum(used) - 1).astype(kind)[ids]
        planes = []
        for bit in reversed(range(max(1, int(len(alphabet) - 1).bit_length()))):
            high = (code & kind(1 << bit)).astype(bool)
            planes.append(np.packbits(high))
            code = np.concatenate([code.compress(~high), code.compress(high)])  # much faster than by masks as indices
        return cls(alphabet, planes, len(ids))

    @cached_property
    def ranks(self) -> list[np.ndarray]:
        """Set bits before each block of each plane."""
        found = []
        for plane in self.planes:
            padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[:len(plane)] = plane
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            found.append(np.concatenate([[0], np.cumsum(ones)]))
        return found

    @cached_property
    def zeros(self) -> list[int]:
        return [self.n - int(r[-1]) for r in self.ranks]

    def _ones(self, level: int, position: int) -> int:
        """Set bits before a position."""
        block = position // BLOCK
        begin = block * BLOCK // 8
        whole, rest = divmod(position, 8)
        total = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][begin:whole]).sum())
        return total + ((int(self.planes[level][whole]) >> (8 - rest)).bit_count() if rest else 0)

    def _bit(self, level: int, position: int) -> int:
        return int(self.planes[level][position // 8]) >> (7 - position % 8) & 1

    def access(self, position: int) -> int:
        code = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, position), self._ones(level, position)
            position = self.zeros[level] + ones if bit else position - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def rank(self, token: int, end: int, begin: int = 0) -> int:
        """Occurrences of an id in [begin, end)."""
        code = self._code(token)
        if code is None:
            return 0
        for level in range(len(self.planes)):
            low, high = self._ones(level, begin), self._ones(level, end)
            if code >> (len(self.planes) - 1 - level) & 1:
                begin, end = self.zeros[level] + low, self.zeros[level] + high
            else:
                begin, end = begin - low, end - high
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(f"id {token} has no occurrence {j}")
        code, begin = self._code(token), 0
        for level in range(len(self.planes)):
            ones = self._ones(level, begin)
            begin = self.zeros[level] + ones if code >> (len(self.planes) - 1 - level) & 1 else begin - ones
        position = begin + j
        for level in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - level) & 1
            position = self._find(level, bit, position - self.zeros[level] if bit else position)
        return position

    def _find(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th bit of this value in a plane."""
        low, high = 0, len(self.ranks[level]) - 1
        before = (lambda b: int(self.ranks[level][b])) if bit else (
            lambda b: min(b * BLOCK, self.n) - int(self.ranks[level][b]))
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if before(middle) <= j else (low, middle)
        bits = np.unpackbits(self.planes[level][low * BLOCK // 8:(low + 1) * BLOCK // 8])
        return low * BLOCK + int(np.flatnonzero(bits == bit)[j - before(low)])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def all_ids(self) -> np.ndarray:
        """All ids in order: the deals of the planes are undone from the last plane to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        code = np.zeros(self.n, kind)
        for level in reversed(range(len(self.planes))):
            high = np.unpackbits(self.planes[level], count=self.n).view(bool)
            low = np.flatnonzero(~high)
            before = np.empty_like(code)
            before[low] = code[:len(low)]
            before[np.flatnonzero(high)] = code[len(low):] | kind(1 << (len(self.planes) - 1 - level))
            code = before
        return self.alphabet[code] if len(self.alphabet) else code


def write_file(ids: np.ndarray, doc_ids: list[int], counts: list[int]) -> bytes:
    """The file's bytes: header, documents, alphabet and planes, compressed part by part."""
    matrix = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), matrix.alphabet.tobytes(),
             *(plane.tobytes() for plane in matrix.planes)]
    parts = [press(part) for part in parts]
    return b"".join([struct.pack("<4sQI", MAGIC, len(ids), len(parts)),
                     struct.pack(f"<{len(parts)}Q", *map(len, parts)), *parts])


def read_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids and their counts of tokens."""
    magic, n, n_parts = struct.unpack_from("<4sQI", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = struct.calcsize("<4sQI")
    sizes = struct.unpack_from(f"<{n_parts}Q", data, at)
    at += 8 * n_parts
    parts = []
    for size in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + size]))
        at += size
    doc_ids, counts, alphabet, *planes = parts
    matrix = WaveletMatrix(np.frombuffer(alphabet, "<u4"), [np.frombuffer(p, np.uint8) for p in planes], n)
    return matrix, np.frombuffer(doc_ids, "<i8"), np.frombuffer(counts, "<i8")


def write_files(documents: DataFrame, tokenizer: str, *, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode all documents and store the files, one row a file, numbered by (part, file) in the order of doc_id.

    A file takes documents until it has `file_tokens` ids. `tokenizer` is a path that every executor can read.
    """
    in_order = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    in_order = in_order.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, doc_ids, counts, total = [], [], [], 0

        def flush():
            nonlocal number, held, doc_ids, counts, total
            data = write_file(np.concatenate(held), doc_ids, counts)
            row = {"part": [part], "file": [number], "first_doc": [doc_ids[0]], "n_docs": [len(doc_ids)],
                   "n_tokens": [total], "data": [data]}
            number, held, doc_ids, counts, total = number + 1, [], [], [], 0
            return row

        for batch in batches:
            for piece, ids, offsets in encoded(batch, "text", tokenizer):
                with_end = np.insert(ids, offsets[1:], END_ID)
                lengths = np.diff(offsets) + 1
                names = [NO_ID if d is None else d for d in piece.column("doc_id").to_pylist()]
                begin, at = 0, 0
                for i, length in enumerate(lengths.tolist()):
                    total += length
                    if total >= file_tokens or i == len(names) - 1:
                        stop = at + int(lengths[begin:i + 1].sum())
                        held.append(with_end[at:stop])
                        doc_ids += names[begin:i + 1]
                        counts += lengths[begin:i + 1].tolist()
                        begin, at = i + 1, stop
                        if total >= file_tokens:
                            yield flush()
        if doc_ids:
            yield flush()

    return materialize(arrow_map(in_order, run, FILES), "wavelet")


def read_documents(files: DataFrame) -> DataFrame:
    """Every document's place, count and checksum, read back from the files.

    Starts are sums over the files before, first of whole parts (one row a task of the writing job).
    """
    per_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    per_part = per_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    places = files.select("part", "file", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("file"))
                                           - F.col("n_tokens")).alias("file_start")).join(per_part, "part")

    def run(batches):
        for batch in batches:
            for part, file, data in zip(*(batch.column(c) for c in ("part", "file", "data"))):
                matrix, doc_ids, counts = read_file(data.as_buffer().to_pybytes())
                raw = memoryview(matrix.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(counts)
                yield {"part": [part.as_py()] * len(counts), "file": [file.as_py()] * len(counts),
                       "row": range(len(counts)),
                       "doc_id": [None if d == NO_ID else d for d in doc_ids.tolist()],
                       "local_start": ends - counts, "n_tokens": counts,
                       "ids_crc32": [zlib.crc32(raw[4 * (e - c):4 * e]) for c, e in zip(counts.tolist(),
                                                                                        ends.tolist())]}

    spans = arrow_map(files.select("part", "file", "data"), run, SPANS)
    return spans.join(places, ["part", "file"]).select(
        "doc_id", (F.col("part_start") + F.col("file_start") + F.col("local_start")).alias("start"),
        "n_tokens", "ids_crc32")
