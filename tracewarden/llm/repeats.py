"""Removal of repeated passages by recompression: shared symbols reveal repeats, windows decide the edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import WHITE_SPACE, ByteWords, byte_kinds, byte_words, scramble
from .filters import name_filter
from .storage import written
from .text import slices
from .urls import BlockedBloom

#: Rounds of run and pair naming; a symbol then stands for about ten words.
ROUNDS = 8
BITS_PER_NAME, FILTER_BYTES = 16, 16 << 20
SLICE_CHARS = 1_000_000
KINDS = byte_kinds(WHITE_SPACE)
_SALT = np.random.default_rng(41).integers(0, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_INVERSE = [pow(int(s), -1, 1 << 64) for s in _SALT[:2]]


class Parse:
    """The symbols of a slice of texts: ``names``, first words (``begin``, and one behind the last) and
    whether a symbol opens a text (``edge``). A name is a digest of the names it was made of."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.names, self.begin = words.copy(), np.arange(len(words) + 1)
        self.edge = np.zeros(len(words), dtype=bool)
        self.edge[starts[:-1][starts[:-1] < starts[1:]]] = True

    def name_runs(self, number: int) -> np.ndarray:
        """Name every run of one symbol; returns the new place of each old symbol."""
        names = self.names
        head = np.ones(len(names), dtype=bool)
        head[1:] = (names[1:] != names[:-1]) | self.edge[1:]
        first = np.flatnonzero(head)
        if len(first) == len(names):
            return np.arange(len(names))
        count = np.diff(np.append(first, len(names)))
        many = np.flatnonzero(count > 1)
        names = names[first]
        with np.errstate(over="ignore"):
            names[many] = scramble(names[many] * _SALT[2] + count[many].astype(np.uint64) + np.uint64(number))
        self.names, self.edge, self.begin = names, self.edge[first], self.begin[np.append(first, len(head))]
        return np.cumsum(head) - 1

    def sides(self, number: int) -> np.ndarray:
        """Which symbols are right ones in this round; a digest of the name decides."""
        with np.errstate(over="ignore"):
            return scramble(self.names + _SALT[3] * np.uint64(number + 1)) >> np.uint64(63) != 0

    def name_pairs(self, right: np.ndarray, number: int) -> np.ndarray:
        """Name every left symbol with the right one behind it; returns the new place of each old symbol."""
        n = len(self.names)
        head = np.ones(n, dtype=bool)
        head[1:] = right[:-1] | ~right[1:] | self.edge[1:]
        second = np.flatnonzero(~head)
        with np.errstate(over="ignore"):
            self.names[second - 1] = scramble(scramble(self.names[second - 1] + np.uint64(number)) * _SALT[4] + self.names[second])
        kept = np.flatnonzero(head)
        self.names, self.edge, self.begin = self.names[kept], self.edge[kept], self.begin[np.append(kept, n)]
        return np.cumsum(head) - 1

    def round(self, number: int) -> None:
        self.name_runs(number)
        self.name_pairs(self.sides(number), number)


def least_of_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the smallest value in every non-empty range, the first one among equals."""
    best, width = [np.arange(len(values))], 1
    while len(low) and 2 * width <= int((high - low).max()):
        a, b = best[-1][:-width], best[-1][width:]
        best.append(np.where(values[b] < values[a], b, a))
        width *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=np.int64)
    for k, table in enumerate(best):
        mine = np.flatnonzero(level == k)
        a, b = table[low[mine]], table[high[mine] - (1 << k)]
        out[mine] = np.where(values[b] < values[a], b, a)
    return out


class Slice:
    """Words, doubles and anchors of one slice of texts."""

    def __init__(self, part: pa.RecordBatch, window: int):
        self.window, self.words = window, byte_words(part.column("text"), KINDS)
        self.digests = self.words.digests()
        starts, n = self.words.starts, len(self.words)
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)  # words from here to the end of the text
        self.windows = np.flatnonzero(left >= window)
        self.sums, self.shift = [], []
        with np.errstate(over="ignore"):
            for lane in range(2):
                powers = np.cumprod(np.full(n, _SALT[lane]), dtype=np.uint64)
                d = scramble(self.digests + np.uint64(lane))
                self.sums.append(np.append(np.uint64(0), np.cumsum(d * powers, dtype=np.uint64)))
                self.shift.append(np.cumprod(np.full(n, np.uint64(_INVERSE[lane])), dtype=np.uint64))

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.starts, word, side="right") - 1

    def names(self, begin: np.ndarray, end: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
        """Digests of passages, 64 bits a lane, by their words alone."""
        with np.errstate(over="ignore"):
            return [
                scramble((self.sums[k][end] - self.sums[k][begin]) * self.shift[k][begin] + (end - begin).astype(np.uint64) * _SALT[5])
                for k in range(lanes)]

    def doubles(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word behind the last) of two high-level symbols in a row, or of a text that is one symbol."""
        p = Parse(self.digests, self.words.starts)
        for number in range(ROUNDS if len(self.words) else 0):
            p.round(number)
        ends = np.append(p.edge[1:], np.ones(min(len(p.edge), 1), dtype=bool))  # the last symbol of a text
        two, one = np.flatnonzero(~ends), np.flatnonzero(ends & p.edge)
        begin, end = np.append(p.begin[two], p.begin[one]), np.append(p.begin[two + 2], p.begin[one + 1])
        wide = end - begin >= self.window
        return begin[wide], end[wide]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which anchor each window has, names, first words): what a window shares with its neighbours.

        A window's point is where the least-named symbol begins among those of the first round that its own words
        determine: not its outermost runs, no right symbol at its front and no left one at its back, as these may
        pair with what lies outside. A window inside one run has its first word as point. The point lies ``r``
        words into the window, and all windows of one point with the same ``r // phase`` hold the
        ``window + 1 - phase`` words that begin ``phase * (r // phase)`` before it.
        """
        windows, phase = self.windows, max(1, (self.window + 1) // 2 - 1)
        if not len(windows):
            return windows, np.zeros(0, dtype=np.uint64), windows
        p, point = Parse(self.digests, self.words.starts), windows.copy()
        place = p.name_runs(0)
        low, high = place[windows] + 1, place[windows + self.window - 1]
        has = low < high
        right = p.sides(0)
        low[has] += right[low[has]]
        high[has] -= ~right[high[has] - 1]
        has = np.flatnonzero(low < high)
        place = p.name_pairs(right, 0)
        point[has] = p.begin[least_of_ranges(p.names, place[low[has]], place[high[has] - 1] + 1)]
        at = point - (point - windows) // phase * phase
        mark = np.zeros(len(self.words), dtype=bool)
        mark[at] = True
        first = np.flatnonzero(mark)
        return (np.cumsum(mark) - 1)[at], self.names(first, first + self.window + 1 - phase, 1)[0], first


def _slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_CHARS):
            yield part, Slice(part, window)


def _rank(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rank of every id in its slice, nulls last, and the ids in that order."""
    order = pc.sort_indices(ids, null_placement="at_end")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(ids))
    return rank, ids.take(order)


def shared_names(texts: DataFrame, window: int) -> BlockedBloom:
    """A filter of the names of doubles and anchors that lie in texts of different ids."""
    kind = texts.schema["event_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _slices(batches, window):
            begin, end = own.doubles()
            _, anchors, places = own.anchors()
            rank, ids = _rank(part.column("event_id"))
            names = np.append(own.names(begin, end, 1)[0], anchors)
            text = rank[own.text_of(np.append(begin, places))]
            order = np.lexsort((text, names))
            names, text = names[order], text[order]
            head = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, dtype=np.int64)
            low, high = text[head], text[np.append(head[1:], len(names)) - 1] if len(head) else head
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[head].view(np.int64)), ids.take(pa.array(low)), ids.take(pa.array(high))], ["name", "low", "high"])

    rows = texts.select("event_id", "text").mapInArrow(name, f"name long, low {kind}, high {kind}")
    both = rows.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("high").isNull()).alias("open"))
    return name_filter(written(_of_several(both).select("name"), "repeat-names"), BITS_PER_NAME, FILTER_BYTES)


def _later(rows: DataFrame) -> DataFrame:
    """(key, begin, end) of the rows whose names also stand in a text of a smaller id.

    Names of one id are left behind by a filter before the rows are shuffled. The names that stay are a
    written table, so that a name of very many rows is a skewed key of a plain join.
    """
    own = F.col("key.event_id")
    first = rows.groupBy("a", "b").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max(own.isNull()).alias("open"))
    first = written(_of_several(first).select("a", "b", "low"), "repeat-first")
    met = rows.where(_held(name_filter(first.select(F.col("a").alias("name")), BITS_PER_NAME, FILTER_BYTES), rows, F.col("a"))).join(first, ["a", "b"])
    return met.where((F.col("low") < own) | own.isNull()).select("key", "begin", "end")


def _of_several(names: DataFrame) -> DataFrame:
    """Names of several ids. A null id is larger than all others: a null beside an id is a second id."""
    return names.where("low < high or (open and low is not null)")


def _held(bloom: BlockedBloom, df: DataFrame, hashed: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(hashes.to_numpy()))

    return held(hashed)


def _map_with_spans(texts: DataFrame, spans: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` (as of mapInArrow) over the texts with the array of the ``spans`` (key, begin, end) that
    belong to them, null without any.

    A filter of the keys keeps texts that have none out of the shuffle. These are picked by the task that
    maps them, so that a task has one Python worker.
    """
    grouped = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # no more than a text has words
    grouped = written(grouped, "repeat-spans-by-text")
    bloom = name_filter(grouped.select(F.xxhash64("key").alias("name")), BITS_PER_NAME, FILTER_BYTES)
    shared = texts.sparkSession.sparkContext.broadcast(bloom)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.filter(pa.array(~shared.value.holds(batch.column("name").to_numpy()))) for batch in batches)

    apart = texts.withColumns({"spans": F.lit(None).cast(grouped.schema["spans"].dataType), "name": F.xxhash64("key")})
    met = texts.where(_held(bloom, texts, F.xxhash64("key"))).join(grouped, "key", "left")
    return met.mapInArrow(function, schema).unionByName(apart.mapInArrow(others, schema))


def _span_arrays(part: pa.RecordBatch, words: ByteWords) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the spans of a slice, in words of the slice."""
    lists = part.column("spans")
    lists = lists.cast(pa.large_list(lists.type.value_type))
    offsets = lists.offsets.to_numpy() if len(lists) else np.zeros(1, dtype=np.int64)
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    flat = lists.flatten()
    base = np.repeat(words.starts[:-1], sizes)
    return flat.field("begin").to_numpy() + base, flat.field("end").to_numpy() + base


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in some span."""
    if not len(begin):
        return np.zeros(n, dtype=bool)
    steps = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _spans_of(texts: DataFrame, window: int, find: Callable, name: str, spans: DataFrame | None = None) -> DataFrame:
    """The passages (first word, word behind the last) that ``find`` gives of every slice, as rows of a written table."""
    key = texts.schema["key"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _slices(batches, window):
            begin, end = find(part, own)
            names, text = own.names(begin, end), own.text_of(begin)
            base, row = own.words.starts[text], pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in names), part.column("key").take(row), pa.array(begin - base), pa.array(end - base)],
                ["a", "b", "key", "begin", "end"])

    schema = f"a long, b long, key {key}, begin long, end long"
    return written(texts.mapInArrow(emit, schema) if spans is None else _map_with_spans(texts, spans, emit, schema), name)


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """(key, begin, end): passages of ``window`` words or more that also stand in a text of a smaller id.

    Together they cover exactly the words of all windows that do.
    """
    shared = texts.sparkSession.sparkContext.broadcast(shared_names(texts, window))

    def doubles(part: pa.RecordBatch, own: Slice) -> tuple[np.ndarray, np.ndarray]:
        begin, end = own.doubles()
        hit = shared.value.holds(own.names(begin, end, 1)[0].view(np.int64))
        return begin[hit], end[hit]

    def edges(part: pa.RecordBatch, own: Slice) -> tuple[np.ndarray, np.ndarray]:
        which, names, _ = own.anchors()
        decided = _covered(len(own.words), *_window_starts(*_span_arrays(part, own.words), window))[own.windows]
        at = own.windows[shared.value.holds(names.view(np.int64))[which] & ~decided]
        return at, at + window

    long = written(_later(_spans_of(texts, window, doubles, "repeat-doubles")).distinct(), "repeat-spans")
    short = _later(_spans_of(texts, window, edges, "repeat-windows", long))
    return long.unionByName(short)


def _window_starts(begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows inside the spans begin."""
    return begin, end - window + 1


def remove_repeats(
    payloads: DataFrame, event_id: str = "event_id", canonical_string: str = "canonical_string", window: int = 13,
) -> DataFrame:
    """Take out every word of a passage of ``window`` words that also stands in a record of a smaller id.

    ``payloads`` are records with an id (integer or text) and a text, such as the canonical strings of
    alerts, where replayed alerts repeat whole passages. Returns one row per record: ``event_id``,
    ``n_words``, ``n_removed``, ``kept_text`` (the words that stay, joined by one space).

    Rounds of recompression name runs of one symbol and pairs of symbols; a name is a 128-bit digest of
    what it stands for, so every task gives the same passage the same names, but for a few symbols at its
    ends. Names of two symbols in a row (some twenty words) that lie in texts of several ids are
    compared first: they settle all windows inside long repeats. Windows left over are compared
    one by one, and only where the words around the deepest symbol that a window determines by itself lie in
    texts of several ids; equal windows determine equal symbols, so no repeat is lost. A Bloom filter of at most
    16 MB carries the shared names to the texts; what it lets pass in vain costs rows and no result, and once
    there are far more shared names than it has room for, all passages are compared.

    Null and empty texts have no words and an empty ``kept_text``. Null ids count as larger than all
    others. Records that share an id never remove each other's words. Other columns are ignored; an empty table
    gives no rows. A record is held whole by its task, and nothing else is.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    texts = payloads.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"))
    texts = texts.withColumn("key", F.struct("event_id", F.xxhash64("text").alias("h")))
    kind = texts.schema["event_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                words = byte_words(part.column("text"), KINDS)
                begin, end = _span_arrays(part, words)
                gone = _covered(len(words), begin, end)
                kept = np.diff(np.append(0, np.cumsum(~gone))[words.starts])
                total = np.diff(words.starts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("event_id"), pa.array(total), pa.array(total - kept), words.joined(~gone)],
                    ["event_id", "n_words", "n_removed", "kept_text"])

    return _map_with_spans(texts, repeated_spans(texts, window), keep, f"event_id {kind}, n_words long, n_removed long, kept_text string")

