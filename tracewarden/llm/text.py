"""Words of whole texts as integer codes, one Arrow batch at a time.

Splitting and dictionary encoding run in Arrow's native code; Python sees each distinct word of a
batch once. A word is a run of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at a time; only the working memory depends on it.
SLICE_CHARS = 4_000_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Words:
    """``codes[starts[i]:starts[i + 1]]`` are the words of text i as indexes into ``distinct``."""

    starts: np.ndarray
    codes: np.ndarray
    distinct: list[str]

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i]:self.starts[i + 1]]

    def __len__(self) -> int:
        return len(self.starts) - 1


def split_words(texts: pa.Array) -> Words:
    """Words of each text in order; null texts have none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = pc.dictionary_encode(flat)
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in distinct:  # from leading and trailing space
        keep = codes != distinct.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        starts, codes = before[starts], codes[keep]
    return Words(starts, codes, distinct)


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``chars`` bytes of text, one row at least.

    Slices are copies: some text functions of Arrow misread a view that does not begin at row 0.
    """
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + chars, side="right")) - 1)
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every piece, one piece after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
