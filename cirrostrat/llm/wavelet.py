"""Wavelet matrix over token ids: bit-planes with rank and select in one compressed file per shard.

Ids are renumbered by falling frequency (ties by id), so the upper planes are nearly empty and compress well; the
planes are stored as zstd blocks beside a rank directory of one 32-bit count per ``BLOCK`` bits.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"CSWM0001"
BLOCK = 2048
_HEAD = struct.Struct("<8sIQIII")


class WaveletMatrix:
    """access, rank, select, count and occurrences of a sequence of non-negative ids below 2**32."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.planes, self.ranks = n, alphabet, planes, ranks
        self.code = {int(a): i for i, a in enumerate(alphabet)}
        self.zeros = [n - self._ones(k, n) for k in range(len(planes))]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        alphabet, inverse, counts = _distinct(ids)
        order = np.lexsort((alphabet, -counts))
        code = np.empty(len(order), dtype=np.uint32)
        code[order] = np.arange(len(order), dtype=np.uint32)
        seq = code[inverse]
        if len(order) <= 1 << 16:
            seq = seq.astype(np.uint16)
        planes, ranks = [], []
        for bit in range(max(1, int(len(order) - 1).bit_length()) - 1, -1, -1) if len(ids) else ():
            ones = (seq >> bit) & 1 != 0
            packed = np.packbits(ones)
            planes.append(packed)
            ranks.append(_directory(packed))
            seq = np.concatenate([np.compress(~ones, seq), np.compress(ones, seq)])
        return WaveletMatrix(len(ids), alphabet[order].astype(np.uint32), planes, ranks)

    def _ones(self, k: int, i: int) -> int:
        """Set bits of plane k before position i."""
        block = i // BLOCK
        own = self.planes[k][block * (BLOCK // 8) : -(-i // 8)]
        if not len(own):
            return int(self.ranks[k][block])
        count = int(np.bitwise_count(own).sum())
        if i % 8:
            count -= (int(own[-1]) & ((1 << (8 - i % 8)) - 1)).bit_count()
        return int(self.ranks[k][block]) + count

    def _bit(self, k: int, i: int) -> int:
        return (int(self.planes[k][i >> 3]) >> (7 - (i & 7))) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _narrow(self, code: int, start: int, end: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if code >> (len(self.planes) - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        code = self.code.get(int(token))
        if code is None:
            return 0
        a, b = self._narrow(code, max(0, start), min(self.n, self.n if end is None else end))
        return max(0, b - a)

    def select(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``token``."""
        code = self.code.get(int(token))
        if code is None or not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._narrow(code, 0, 0)[0] + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - k) & 1
            i = self._nth(k, i - self.zeros[k] if bit else i, bit)
        return i

    def _nth(self, k: int, j: int, bit: int) -> int:
        """Position of the j-th (from 0) bit of that value in plane k."""
        before = self.ranks[k] if bit else np.arange(len(self.ranks[k])) * BLOCK - self.ranks[k]
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """The whole sequence: the sorted bottom order taken back up, plane by plane."""
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        small = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        seq = np.zeros(self.n, dtype=small)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up, z = np.empty(self.n, dtype=small), self.zeros[k]
            up[np.flatnonzero(~ones)], up[np.flatnonzero(ones)] = seq[:z], seq[z:] | small(1 << (len(self.planes) - 1 - k))
            seq = up
        return self.alphabet[seq]


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique(ids, return_inverse, return_counts), by counting where ids are small."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.uint32)
    place[values] = np.arange(len(values), dtype=np.uint32)
    return values, place[ids], counts[values]


def _directory(packed: np.ndarray) -> np.ndarray:
    """Set bits before each block of BLOCK bits."""
    pad = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
    pad[: len(packed)] = np.bitwise_count(packed)
    return np.concatenate([[0], np.cumsum(pad.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64))]).astype(np.uint32)


def dump(wm: WaveletMatrix, doc_ids: list, lengths: np.ndarray, level: int = 1) -> bytes:
    """A shard's file: header, document table (ids, null flags, lengths), alphabet, then for each plane ranks and bits."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    parts = [pack(ids.tobytes()), pack(null.tobytes()), pack(lengths.astype("<u8").tobytes()), pack(wm.alphabet.astype("<u4").tobytes())]
    for bits, ranks in zip(wm.planes, wm.ranks, strict=True):
        parts += [pack(ranks.astype("<u4").tobytes()), pack(bits.tobytes())]
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return _HEAD.pack(MAGIC, len(doc_ids), wm.n, len(wm.alphabet), len(wm.planes), len(parts)) + sizes + b"".join(parts)


def load(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, doc_ids, lengths) of a shard's file."""
    import zstandard

    magic, n_docs, n, _, n_planes, n_parts = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    sizes, at, parts = struct.unpack_from(f"<{n_parts}Q", data, _HEAD.size), _HEAD.size + 8 * n_parts, []
    unpack = zstandard.ZstdDecompressor().decompress
    for size in sizes:
        parts.append(unpack(data[at : at + size]))
        at += size
    null = np.unpackbits(np.frombuffer(parts[1], dtype=np.uint8), count=n_docs) if n_docs else []
    doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(parts[0], dtype="<i8"), null, strict=True)]
    planes = [np.frombuffer(parts[5 + 2 * k], dtype=np.uint8) for k in range(n_planes)]
    ranks = [np.frombuffer(parts[4 + 2 * k], dtype="<u4") for k in range(n_planes)]
    return WaveletMatrix(n, np.frombuffer(parts[3], dtype="<u4"), planes, ranks), doc_ids, np.frombuffer(parts[2], dtype="<u8").astype(np.int64)
