"""Words of whole texts by byte classes, and digests of words, in numpy.

Every byte is a word byte, a separator or a break; bytes of characters beyond ASCII are word bytes
unless a table says otherwise, so a word is never cut inside a character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .text import ragged

WORD, SEPARATOR, BREAK = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Longer words are digested one by one.
LONG_WORD = 64
_SALT = np.random.default_rng(977).integers(0, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def byte_kinds(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(separators)] = SEPARATOR
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass(frozen=True)
class ByteWords:
    """Word j is ``data[begin[j]:end[j]]``; text i has the words ``starts[i]`` to ``starts[i + 1]``.

    ``breaks[j]`` counts the break bytes before word j in its slice.
    """

    starts: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray
    breaks: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)

    def coded(self) -> tuple[np.ndarray, pa.LargeStringArray]:
        """(codes, distinct words)."""
        sizes = self.end - self.begin
        offsets, data = np.append(0, np.cumsum(sizes)), self.data[ragged(self.begin, sizes)]
        found = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary

    def digests(self) -> np.ndarray:
        """A 64-bit digest of every word, the same in every task."""
        return digests_of(self.data, self.begin, self.end)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        starts = np.append(0, np.cumsum(kept))[self.starts]
        sizes = (self.end - self.begin)[kept]
        ends = np.append(0, np.cumsum(sizes + 1))  # a space behind every word but the last of a text
        bounds = ends[starts]
        flat = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
        flat[ragged(ends[:-1], sizes)] = self.data[ragged(self.begin[kept], sizes)]
        last = np.zeros(len(flat), dtype=bool)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        bounds = bounds - np.append(0, np.cumsum(bounds[1:] > bounds[:-1]))
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(flat[~last])).cast(pa.string())


def byte_words(texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> ByteWords:
    """Maximal runs of word bytes of each text; null texts have none."""
    bounds, data = string_buffers(texts.cast(pa.large_string()).fill_null(""))
    kind = kinds[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.equal(kind, WORD, out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = turns[0::2], turns[1::2]
    heads = np.unique(bounds[1:-1])
    heads = heads[inside[heads] & inside[heads + 1]]  # texts that meet without a separator
    if len(heads):
        begin, end = np.sort(np.append(begin, heads)), np.sort(np.append(end, heads))
    breaks = np.cumsum(kind == BREAK, dtype=np.int32)[begin] if len(begin) and (kinds == BREAK).any() else np.zeros(len(begin), np.int32)
    return ByteWords(np.searchsorted(begin, bounds), begin, end, LOWER[data] if lower else data, breaks)


def string_buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array without nulls."""
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bounds - bounds[0], flat[bounds[0]:bounds[-1]]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of ``data[begin:end]``, eight bytes at a time."""
    sizes = end - begin
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place
    with np.errstate(over="ignore"):
        out = sizes.astype(np.uint64) * _SALT[0]
        rows, at = np.arange(len(begin)), 0
        while len(rows):
            chunk = eight[begin[rows] + at] & _MASKS[np.minimum(sizes[rows] - at, 8)]
            out[rows] = scramble(out[rows] * _SALT[1] + chunk)
            at += 8
            rows = rows[(sizes[rows] > at) & (sizes[rows] <= LONG_WORD)]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i]:end[i]])
    return out
