"""A wavelet matrix over token ids, kept in one compressed block of bytes.

Bit b of every id is in plane b; a plane holds the ids in the order that stable partitions by the higher bits leave.
Each plane is compressed by itself, so a lookup inflates only what it reads. Beside each plane stands the number of
ones before every 512th bit, which gives rank in constant time and select by a search in that list.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"SLWM"
VERSION = 1
HEAD = struct.Struct("<4sHHIQQQ")
BLOCK = 8  # words of 64 bits
PART = 1 << 17


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        ones = np.bitwise_count(words).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = n - int(self.before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        size = -(-max(len(bits), 1) // (64 * BLOCK)) * 8 * BLOCK
        raw = np.zeros(size, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        return cls(raw.view("<u8"), len(bits))

    def parts(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """values and the plane's bits beside them, in parts that fit a processor's cache."""
        raw = self.words.view(np.uint8)
        for at in range(0, self.n, PART):
            part = values[at : at + PART]
            yield part, np.unpackbits(raw[at // 8 :], bitorder="little", count=len(part)).view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, block = i >> 6, i >> 9
        count = self.before[block].copy()
        for k in range(BLOCK - 1):  # whole words of the block before the last one
            w = (block << 3) + k
            inside = w < word
            count[inside] += np.bitwise_count(self.words[w[inside]])
        rest = (i & 63) > 0
        low = (np.uint64(1) << (i[rest] & 63).astype(np.uint64)) - np.uint64(1)
        count[rest] += np.bitwise_count(self.words[word[rest]] & low)
        return count

    def select(self, k: int, bit: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        starts = self.before if bit else (np.arange(len(self.before)) << 9) - self.before
        block = int(np.searchsorted(starts, k, "right")) - 1
        part = np.unpackbits(self.words[block * BLOCK : (block + 1) * BLOCK].view(np.uint8), bitorder="little")
        return (block << 9) + int(np.flatnonzero(part == bit)[k - int(starts[block])])


class WaveletMatrix:
    """Ids with access, rank, select and occurrence lookup."""

    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n  # from the highest bit down

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for b in range(bits - 1, -1, -1):
            plane = Plane.of((now & now.dtype.type(1 << b)) != 0)
            planes.append(plane)
            if b:
                after, low, high = np.empty_like(now), 0, plane.zeros
                for part, one in plane.parts(now):
                    zeros, ones = np.compress(~one, part), np.compress(one, part)
                    after[low : low + len(zeros)], after[high : high + len(ones)] = zeros, ones
                    low, high = low + len(zeros), high + len(ones)
                now = after
        return cls(planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids in their order."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            above, low, high = np.empty_like(now), 0, plane.zeros
            for part, one in plane.parts(above):
                where = np.flatnonzero(one)
                n = len(part) - len(where)
                part[np.flatnonzero(~one)] = now[low : low + n]
                part[where] = now[high : high + len(where)] | now.dtype.type(1 << b)
                low, high = low + n, high + len(where)
            now = above
        return now

    def access(self, positions) -> np.ndarray:
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit = plane.get(at).astype(bool)
            ones = plane.rank1(at)
            at = np.where(bit, plane.zeros + ones, at - ones)
            out = (out << 1) | bit
        return out

    def _range(self, token: int, start: int, end: int) -> np.ndarray:
        """Where the token's occurrences among [start, end) stand below the last plane."""
        ends = np.array([start, end], np.int64)
        for b, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            ones = plane.rank1(ends)
            ends = plane.zeros + ones if token >> b & 1 else ends - ones
        return ends

    def known(self, token: int) -> bool:
        return 0 <= token < 1 << len(self.planes)

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of the token before position end (in all, if not given)."""
        if not self.known(token):
            return 0
        low, high = self._range(token, 0, self.n if end is None else end)
        return int(high - low)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = int(self._range(token, 0, self.n)[0]) + k
        for b, plane in enumerate(reversed(self.planes)):
            at = plane.select(at - plane.zeros, 1) if token >> b & 1 else plane.select(at, 0)
        return at

    def locate(self, token: int) -> list[int]:
        """All positions of the token."""
        return [self.select(token, k) for k in range(self.rank(token))]


def dump(matrix: WaveletMatrix, doc_ids: np.ndarray, lengths: np.ndarray, shard: int, null_ids: int = 0) -> bytes:
    """One shard as bytes: a header, the length of each part, then the compressed parts.

    Parts: document ids (the first null_ids of them stand for null), their numbers of tokens, the planes.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(doc_ids.astype("<i8").tobytes()), pack(lengths.astype("<i8").tobytes())]
    parts += [pack(p.words.tobytes()) for p in matrix.planes]
    head = HEAD.pack(MAGIC, VERSION, len(matrix.planes), null_ids, shard, matrix.n, len(doc_ids))
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class Shard:
    """A shard read from bytes; planes are inflated when first used. Bytes after the declared parts are ignored."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.null_ids, self.number, self.n, self.docs = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of a known version")
        sizes = struct.unpack_from(f"<{self.bits + 2}Q", data, HEAD.size)
        at, self._parts = HEAD.size + 8 * len(sizes), []
        for size in sizes:
            if at + size > len(data):
                raise ValueError("token shard is cut short")
            self._parts.append(memoryview(data)[at : at + size])
            at += size
        self._matrix: WaveletMatrix | None = None

    def _inflate(self, part: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._parts[part])

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._inflate(0), "<i8")

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._inflate(1), "<i8")

    @property
    def matrix(self) -> WaveletMatrix:
        if self._matrix is None:
            planes = [Plane(np.frombuffer(self._inflate(2 + k), "<u8"), self.n) for k in range(self.bits)]
            self._matrix = WaveletMatrix(planes, self.n)
        return self._matrix
