"""One shard of token ids as a wavelet matrix: bit-planes with rank and select in one file."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa

MAGIC = b"TWM1"
#: Bits between two entries of the rank directory.
RANK_BITS = 512


class WaveletMatrix:
    """Token ids of consecutive records, with access, counting and occurrence lookup.

    Plane 0 holds the top bit of every id in order; each further plane holds the next bit after a
    stable split by the bits above. ``rank`` needs a directory entry and the bytes behind it.
    """

    def __init__(self, planes: np.ndarray, zeros: np.ndarray, length: int, ids: list, counts: np.ndarray):
        self.planes, self.zeros, self.length, self.ids, self.counts = planes, zeros, length, ids, counts
        step = RANK_BITS // 8
        padded = np.zeros((len(planes), -(-max(planes.shape[1], 1) // step) * step), dtype=np.uint8)
        padded[:, :planes.shape[1]] = planes
        ones = np.bitwise_count(padded).reshape(len(planes), -1, step).sum(axis=2, dtype=np.int64)
        self.directory = np.concatenate([np.zeros((len(planes), 1), dtype=np.int64), np.cumsum(ones, axis=1)], axis=1)
        self.padded = padded

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int, ids: list, counts: np.ndarray) -> WaveletMatrix:
        planes = np.zeros((bits, -(-len(tokens) // 8)), dtype=np.uint8)
        zeros = np.zeros(bits, dtype=np.int64)
        rest = tokens
        for level in range(bits):
            bit = (rest >> np.array(bits - 1 - level, dtype=rest.dtype)) & np.array(1, dtype=rest.dtype) != 0
            planes[level] = np.packbits(bit, bitorder="little")
            low = rest[~bit]
            zeros[level] = len(low)
            rest = np.concatenate([low, rest[bit]])
        return cls(planes, zeros, len(tokens), ids, counts)

    # --- queries ---------------------------------------------------------------------------------
    def _rank1(self, level: int, position: int) -> int:
        block = position // RANK_BITS
        start = block * RANK_BITS // 8
        total = int(self.directory[level, block])
        whole, left = divmod(position - block * RANK_BITS, 8)
        total += int(np.bitwise_count(self.padded[level, start:start + whole]).sum())
        return total + (int(self.padded[level, start + whole] & ((1 << left) - 1)).bit_count() if left else 0)

    def access(self, position: int) -> int:
        """Token at a position."""
        if not 0 <= position < self.length:
            raise IndexError(position)
        value = 0
        for level in range(len(self.planes)):
            bit = self.planes[level, position >> 3] >> (position & 7) & 1
            ones = self._rank1(level, position)
            position = int(self.zeros[level]) + ones if bit else position - ones
            value = value << 1 | int(bit)
        return value

    def rank(self, token: int, position: int) -> int:
        """How often a token occurs before a position."""
        low, high, bits = 0, min(max(position, 0), self.length), len(self.planes)
        if token >> bits:
            return 0
        for level in range(bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if token >> (bits - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token, -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        low, high = 0, self.length - 1  # the first position with k + 1 occurrences up to it
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.rank(token, middle + 1) <= k else (low, middle)
        return low

    def tokens(self) -> np.ndarray:
        """All ids in order, rebuilt from the last plane upwards."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        below = np.zeros(self.length, dtype=kind)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.length, bitorder="little").view(bool)
            here = np.empty(self.length, dtype=kind)
            here[~bit] = below[:self.zeros[level]]
            here[bit] = below[self.zeros[level]:] | kind(1 << (bits - 1 - level))
            below = here
        return below

    # --- file ------------------------------------------------------------------------------------
    def to_bytes(self) -> bytes:
        """Magic, header length, JSON header, then zstd sections: ids, counts, one per plane."""
        sections = [json.dumps(self.ids).encode(), self.counts.astype("<u4").tobytes(), *[p.tobytes() for p in self.planes]]
        codec = pa.Codec("zstd", 1)
        packed = [codec.compress(s, asbytes=True) for s in sections]
        header = json.dumps({
            "length": self.length, "zeros": self.zeros.tolist(), "raw": [len(s) for s in sections], "packed": [len(p) for p in packed],
        }).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", data, 4)
        header = json.loads(data[8:8 + size])
        codec, at, sections = pa.Codec("zstd"), 8 + size, []
        for raw, packed in zip(header["raw"], header["packed"]):
            sections.append(codec.decompress(data[at:at + packed], raw, asbytes=True) if raw else b"")
            at += packed
        planes = np.array([np.frombuffer(s, dtype=np.uint8) for s in sections[2:]], dtype=np.uint8)
        return cls(planes.reshape(len(header["zeros"]), -1), np.array(header["zeros"]), header["length"],
                   json.loads(sections[0]), np.frombuffer(sections[1], dtype="<u4").astype(np.int64))
