"""Token ids of whole texts with a public tokenizer, each distinct piece of text encoded once.

Both vocabularies split a text before any merge, and never across the cuts made here, so the ids of
a text are the ids of its pieces one after the other. Pieces are cut and counted in Arrow's native
code; the tokenizer itself only sees pieces that the worker has not met yet. Texts for which the cut
is not proven safe go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import ragged
from .worker import claim, release

#: Pieces a worker remembers before it lets those go that it met in one slice only.
CACHE_PIECES = 600_000
#: Characters of text that are cut and looked up at a time; longer slices take more memory and no less time.
SLICE_CHARS = 1_000_000
#: Pieces that the tokenizer gets as one text.
TOGETHER = 500
#: White space beyond ASCII, and single spaces that do not stand between two other characters.
UNICODE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ODD_SPACE = rf"^ | $|[\x20\x09-\x0D] | [\x20\x09-\x0D]|{UNICODE_SPACE}"
WORD_END = "</w>"
#: Marks at the end of a piece, behind an ASCII letter or digit, are a token group of their own.
TAIL = r"[A-Za-z0-9](?P<tail>[.,;:!?]+)$"

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Encodes batches of texts; one per worker process and vocabulary (``encoder``).

    ``spaced`` says that a word's token carries the space before it (byte-level vocabularies).
    Otherwise white space is dropped before merging and the last token of a word has an end mark.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level token has a character for each of its bytes
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.token_ends = np.zeros(len(self.token_bytes), dtype=bool)
        for token, i in vocabulary.items():
            self.token_bytes[i], self.token_ends[i] = len(token), token.endswith(WORD_END)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)
        self.starts, self.used = np.zeros(1 << 16, dtype=np.int64), 0
        self.met = np.zeros(1 << 16, dtype=np.int32)

    def _thin(self) -> None:
        """Keep the pieces of more than one slice; start over if they alone fill half of the room."""
        n = len(self.known)
        keep = np.flatnonzero(self.met[:n] > 1)
        pieces = list(self.known)
        lengths = np.diff(self.starts[:n + 1])[keep]
        flat = self.flat[ragged(self.starts[keep], lengths)]
        self._forget()
        if len(keep) <= CACHE_PIECES // 2:
            self._store([pieces[i] for i in keep.tolist()], flat, lengths)

    def _store(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[first + 1:first + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: list[str]) -> None:
        """Encode new pieces: stems that are not known yet, then pieces of a stem and a tail from these two."""
        column = pa.array(pieces, pa.large_string())
        ended = pc.match_substring_regex(column, TAIL)
        both = column.filter(ended)
        stems, tails = (x.to_numpy(zero_copy_only=False).tolist() for x in (pc.utf8_rtrim(both, ".,;:!?"), pc.extract_regex(both, TAIL).field("tail")))
        self._encode([x for x in dict.fromkeys(column.filter(pc.invert(ended)).to_numpy(zero_copy_only=False).tolist() + stems + tails) if x not in self.known])
        if not stems:
            return
        parts = np.array([list(map(self.known.get, stems)), list(map(self.known.get, tails))], dtype=np.int64).T.ravel()
        np.add.at(self.met, parts, 1)
        lengths = self.starts[parts + 1] - self.starts[parts]
        self._store(both.to_numpy(zero_copy_only=False).tolist(), self.flat[ragged(self.starts[parts], lengths)], lengths.reshape(-1, 2).sum(axis=1))

    def _encode(self, pieces: list[str]) -> None:
        """Let the tokenizer see new pieces. Plain ones are joined, as it cuts them apart again."""
        column = pa.array(pieces, pa.large_string())
        if self.spaced:
            # a piece that opens a text or holds a special token is left alone
            joint = pc.and_(pc.match_substring_regex(column, r"^ [^ ]"), pc.invert(pc.match_substring_regex(column, "|".join(map(re.escape, self.special)))))
            size = pc.binary_length(column).to_numpy()
        else:
            joint = pc.match_substring_regex(column, "^[A-Za-z]+$")  # one word and one end mark each
        joint = joint.to_numpy(zero_copy_only=False)
        together, alone = np.flatnonzero(joint), np.flatnonzero(~joint)
        lists = self._ids([pieces[i] for i in alone.tolist()])
        glue = "" if self.spaced else " "
        names = [pieces[i] for i in together.tolist()]
        groups = self._ids([glue.join(names[i:i + TOGETHER]) for i in range(0, len(names), TOGETHER)])
        flat = np.fromiter(chain.from_iterable(groups), dtype=self.flat.dtype)
        if self.spaced:
            ends = np.searchsorted(np.cumsum(self.token_bytes[flat]), np.cumsum(size[together])) + 1
        else:
            ends = np.flatnonzero(self.token_ends[flat]) + 1
        if len(ends) != len(together) or (len(ends) and ends[-1] != len(flat)):
            raise RuntimeError("the vocabulary does not keep pieces apart")
        self._store(names, flat, np.diff(np.append(0, ends)))
        self._store([pieces[i] for i in alone.tolist()], np.fromiter(chain.from_iterable(lists), dtype=self.flat.dtype),
                    np.array([len(x) for x in lists], dtype=np.int64))

    def _cut(self, texts: pa.Array) -> pa.LargeListArray:
        if not self.spaced:
            # the vocabulary lower-cases; special tokens are told by their case, and all of them hold "<|"
            return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        lists = pc.split_pattern(texts, pattern=" ")
        starts, n = lists.offsets.to_numpy(), len(texts)
        flat = lists.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        first = np.zeros(len(flat), dtype=bool)
        first[starts[:-1][starts[:-1] < starts[1:]]] = True
        flat = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " ").cast(pa.large_string()), flat, pa.scalar("", pa.large_string()))
        if not pc.any(odd).as_py():
            return pa.LargeListArray.from_arrays(pa.array(starts), flat)
        whole = odd.to_numpy(zero_copy_only=False)
        keep = np.repeat(~whole, np.diff(starts))
        lengths = np.where(whole, 1, np.diff(starts))
        at = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.empty(at[-1], dtype=np.int64)
        mask = np.zeros(at[-1], dtype=bool)
        mask[at[:-1][whole]] = True
        pick[~mask] = np.flatnonzero(keep)
        pick[mask] = len(flat) + np.arange(whole.sum())
        both = pa.concat_arrays([flat, texts.filter(odd)])
        return pa.LargeListArray.from_arrays(pa.array(at[: n + 1]), both.take(pa.array(pick)))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): ids of text i are ``ids[starts[i]:starts[i + 1]]``, ``end_id`` last."""
        lists = self._cut(texts.cast(pa.large_string()).fill_null(""))
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(starts[0], starts[-1] - starts[0]))
        starts, distinct = starts - starts[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > CACHE_PIECES:
            self._thin()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        if len(missing := np.flatnonzero(number < 0)):
            new = [distinct[i] for i in missing.tolist()]
            self._remember(new)
            number[missing] = np.fromiter(map(self.known.get, new), dtype=np.int64, count=len(new))
        self.met[number] += 1
        piece = number[coded.indices.to_numpy()]
        lengths = self.starts[piece + 1] - self.starts[piece]
        before = np.concatenate([[0], np.cumsum(lengths)])[starts]
        body = self.flat[ragged(self.starts[piece], lengths)]
        out_starts = before + np.arange(len(before))
        ids = np.empty(out_starts[-1], dtype=self.flat.dtype)
        is_end = np.zeros(len(ids), dtype=bool)
        is_end[out_starts[1:] - 1] = True
        ids[is_end], ids[~is_end] = end_id, body
        return out_starts, ids


def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this worker process."""
    claim(f"encoder {path} {spaced}", _ENCODERS.clear)
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def encoded(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end_id: int, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts."""
    from .text import slices

    own = encoder(path, spaced)
    for batch in batches:
        for part in slices(batch, text, SLICE_CHARS):
            yield part, *own.encode(part.column(text), end_id)
    release()
