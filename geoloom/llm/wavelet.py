"""A wavelet matrix over token ids, and the shard file that holds one.

File format, version 2, all integers little-endian:

* 48 bytes: magic ``GLWM0002``, then u64 tokens, u64 documents, u64 levels,
  u64 bytes of the compressed directory, u64 rank step in bits;
* the directory, zstandard: i64 doc_id, then u64 first token in this shard, then
  u64 tokens, each for all documents;
* for each level, from the highest bit of the ids to the lowest: u64 zeros of the
  level, u64 bytes of its rank table; the table, u32 ones before each rank step by
  their differences, as a zstandard frame; then the bits, eight to a byte, the
  first in the highest place, in blocks of ``BLOCK`` bytes: u32 bytes of each, then
  each as a zstandard frame, or as it is where that isn't smaller.

``WaveletMatrix`` answers access, rank and select from the compressed planes: a
question unpacks one block of each level that it comes by, and the latest ones stay unpacked.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"GLWM0002"
HEAD = struct.Struct("<8s5Q")
STEP = 4096
#: Bytes of a plane that are compressed on their own, and blocks of a plane that stay unpacked.
BLOCK, KEPT = 1 << 15, 8
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


class Plane:
    """The bits of a level, in compressed blocks."""

    def __init__(self, size: int, blocks: list[bytes]):
        self.size, self.blocks, self.open = size, blocks, {}

    @classmethod
    def build(cls, data: np.ndarray) -> Plane:
        pack, blocks = zstandard.ZstdCompressor(level=1), []
        for begin in range(0, len(data), BLOCK):
            raw = data[begin : begin + BLOCK].tobytes()
            small = pack.compress(raw)
            blocks.append(small if len(small) < len(raw) else raw)
        return cls(len(data), blocks)

    def _unpacked(self, k: int) -> np.ndarray:
        size = min(BLOCK, self.size - k * BLOCK)
        raw = self.blocks[k]
        return np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, max_output_size=size), dtype=np.uint8)

    def block(self, k: int) -> np.ndarray:
        if k not in self.open:
            if len(self.open) == KEPT:
                del self.open[next(iter(self.open))]
            self.open[k] = self._unpacked(k)
        return self.open[k]

    def byte(self, at: int) -> int:
        return int(self.block(at // BLOCK)[at % BLOCK])

    def ones(self, begin: int, end: int) -> int:
        """Ones of bytes of one rank step, which no block's edge cuts."""
        first = begin // BLOCK * BLOCK
        return int(ONES[self.block(begin // BLOCK)[begin - first : end - first]].sum(dtype=np.int64)) if end > begin else 0

    def bits(self, n: int) -> np.ndarray:
        """The first n bits, unpacked at once."""
        whole = np.concatenate([self._unpacked(k) for k in range(len(self.blocks))]) if self.blocks else np.zeros(0, np.uint8)
        return np.unpackbits(whole, count=n).astype(bool)


class WaveletMatrix:
    """Bit planes with rank support; ids below 2 ** levels."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int = 16) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            ones = (ids >> level & 1).astype(bool)
            plane = np.packbits(ones)
            planes.append(Plane.build(plane))
            ranks.append(cls._ranks(plane))
            low, high = ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))  # places, since random masks are slow
            zeros.append(len(low))
            ids = np.concatenate([low, high])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _ranks(plane: np.ndarray) -> np.ndarray:
        starts = np.arange(0, len(plane), STEP // 8)
        steps = np.add.reduceat(ONES[plane], starts, dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(steps)]).astype("<u4")

    def decode(self) -> np.ndarray:
        """All ids in their order."""
        ids = np.zeros(self.n, dtype=np.uint32 if len(self.planes) > 16 else np.uint16)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = self.planes[k].bits(self.n)
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[: self.zeros[k]]
            above[np.flatnonzero(ones)] = ids[self.zeros[k] :] | ids.dtype.type(1 << (len(self.planes) - 1 - k))
            ids = above
        return ids

    def _ones(self, level: int, i: int) -> int:
        """Ones before bit i of a level."""
        step, byte, plane = i // STEP, i // 8, self.planes[level]
        total = int(self.ranks[level][step]) + plane.ones(step * (STEP // 8), byte)
        return total + (int(ONES[plane.byte(byte) >> (8 - i % 8)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, plane in enumerate(self.planes):
            bit = plane.byte(i // 8) >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, value: int, i: int) -> tuple[int, int]:
        """Where the first occurrence of value, and those before i, stand below the last level."""
        begin, end = 0, i
        for k in range(len(self.planes)):
            a, b = self._ones(k, begin), self._ones(k, end)
            begin, end = (self.zeros[k] + a, self.zeros[k] + b) if value >> (len(self.planes) - 1 - k) & 1 else (begin - a, end - b)
        return begin, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before place i."""
        if not 0 <= value < 1 << len(self.planes):
            return 0
        begin, end = self._interval(value, min(max(i, 0), self.n))
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """The place of the nth occurrence of value, from 0."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        i = self._interval(value, 0)[0] + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = bool(value >> (len(self.planes) - 1 - k) & 1)
            i = self._select_bit(k, one, i - self.zeros[k] if one else i)
        return i

    def _select_bit(self, level: int, one: bool, nth: int) -> int:
        """The place of the nth one or zero of a level, by bisection over its ranks."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            ones = self._ones(level, mid)
            if (ones if one else mid - ones) <= nth:
                low = mid
            else:
                high = mid
        return low

    def find(self, value: int) -> list[int]:
        """All places of value, in order."""
        return [self.select(value, k) for k in range(self.count(value))]


def to_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray, levels: int = 16) -> bytes:
    """A shard file of documents in the given order; ids holds their tokens."""
    matrix = WaveletMatrix.build(ids, levels)
    sizes = np.array(lengths, dtype="<u8")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8") if len(sizes) else sizes
    directory = zstandard.ZstdCompressor().compress(np.array(doc_ids, dtype="<i8").tobytes() + starts.tobytes() + sizes.tobytes())
    parts = [HEAD.pack(MAGIC, len(ids), len(doc_ids), levels, len(directory), STEP), directory]
    for plane, zeros, ranks in zip(matrix.planes, matrix.zeros, matrix.ranks, strict=True):
        table = zstandard.ZstdCompressor().compress(np.diff(ranks, prepend=np.zeros(1, "<u4")).astype("<u4").tobytes())
        sizes = np.array([len(x) for x in plane.blocks], dtype="<u4")
        parts += [struct.pack("<QQ", zeros, len(table)), table, sizes.tobytes(), *plane.blocks]
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, first tokens and lengths of a shard file, and its matrix; planes stay packed."""
    magic, n, docs, levels, size, step = HEAD.unpack_from(data)
    if magic != MAGIC or step != STEP:
        raise ValueError("not a shard file of this version")
    at = HEAD.size + size
    directory = zstandard.ZstdDecompressor().decompress(data[HEAD.size : at])
    doc_ids, starts, lengths = (np.frombuffer(directory, kind, docs, k * 8 * docs) for k, kind in enumerate(("<i8", "<u8", "<u8")))
    planes, zeros, ranks, size, view = [], [], [], (n + 7) // 8, memoryview(data)
    for _ in range(levels):
        zero, table = struct.unpack_from("<QQ", data, at)
        at += 16
        steps = zstandard.ZstdDecompressor().decompress(data[at : at + table])
        at += table
        sizes = np.frombuffer(data, "<u4", -(-size // BLOCK), at).tolist()
        at += 4 * len(sizes)
        blocks = []
        for x in sizes:
            blocks.append(view[at : at + x])
            at += x
        zeros.append(zero)
        ranks.append(np.cumsum(np.frombuffer(steps, "<u4"), dtype="<u4"))
        planes.append(Plane(size, blocks))
    return doc_ids, starts, lengths, WaveletMatrix(n, planes, zeros, ranks)
