"""Ranked lexical search: bit-sliced Bloom signatures bound every score, exact scores decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import byte_kinds, byte_words, scramble
from .phrases import digests_of_strings
from .storage import written
from .text import slices

#: A term is a run of ASCII letters and digits and of characters beyond ASCII.
KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A signature holds a term once for each of these numbers of occurrences that it reaches.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64])
HASHES, BITS_PER_KEY = 6, 12
#: Keys that a task gathers, bits of one block of records, and cells of one bound table.
GATHERED_KEYS, BLOCK_BITS, CELLS = 4_000_000, 1 << 24, 1 << 22
#: Term occurrences in one block of searches.
SEARCH_TERMS = 50_000
_SALTS = np.random.default_rng(613).integers(0, 1 << 63, max(HASHES, len(LEVELS)) + 1, dtype=np.uint64) | np.uint64(1)


def _key_of(terms: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(terms + _SALTS[level])


def _places(keys: np.ndarray, slices_: int) -> Iterator[np.ndarray]:
    """The slices of every key in signatures of so many slices."""
    for i in range(HASHES):
        with np.errstate(over="ignore"):
            yield ((scramble(keys * _SALTS[i]) >> np.uint64(32)) * np.uint64(slices_) >> np.uint64(32)).astype(np.int64)


def _term_counts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(terms of each text, text, term code and occurrences of every text and term, distinct terms)."""
    words = byte_words(part.column("text"), KINDS, lower=True)
    codes, distinct = words.coded()
    text = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
    both, n = np.unique(text * np.int64(max(len(distinct), 1)) + codes, return_counts=True)
    return np.diff(words.starts), both // max(len(distinct), 1), both % max(len(distinct), 1), n, distinct


def build_signatures(texts: DataFrame) -> DataFrame:
    """Bit-sliced signatures of all records: one row per block of records of about the same number of keys.

    A key is a term that occurs at least so often (``LEVELS``). ``slices`` holds ``n_slices`` bitmaps over the
    rows of the block, one after the other; a record's signature is its column. ``ids``, ``hashes`` and ``sizes``
    name the rows and count their terms. Records without a term are left out.
    """
    kind = texts.schema["event_id"].dataType.simpleString()

    def block(ids: pa.Array, hashes: pa.Array, sizes: np.ndarray, n_slices: int, row: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        bits = np.zeros((n_slices, len(sizes)), dtype=bool)
        for place in _places(keys, n_slices):
            bits[place, row] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [one(ids), one(hashes), one(pa.array(sizes)), pa.array([n_slices], pa.int64()), pa.array([packed.tobytes()], pa.binary())],
            ["ids", "hashes", "sizes", "n_slices", "slices"])

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, hashes = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        sizes, counts, keys = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        ends = np.cumsum(counts)
        scale = np.frexp(np.maximum(counts, 1).astype(np.float64) - 0.5)[1]
        for c in np.unique(scale[counts > 0]).tolist():
            rows = np.flatnonzero((scale == c) & (counts > 0))
            n_slices = BITS_PER_KEY << c
            step = max(8, BLOCK_BITS // n_slices)
            for at in range(0, len(rows), step):
                mine = rows[at:at + step]
                own = np.concatenate([keys[ends[r] - counts[r]:ends[r]] for r in mine.tolist()])
                yield block(ids.take(pa.array(mine)), hashes.take(pa.array(mine)), sizes[mine], n_slices, np.repeat(np.arange(len(mine)), counts[mine]), own)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, text, term, n, distinct = _term_counts(part)
                digests = digests_of_strings(distinct)
                level = np.searchsorted(LEVELS, n, side="right")
                pick = np.repeat(np.arange(len(n)), level)
                rank = np.arange(len(pick)) - np.repeat(np.cumsum(level) - level, level)
                counts = np.bincount(text, weights=level, minlength=part.num_rows).astype(np.int64)
                held.append((part.column("event_id"), part.column("h"), sizes, counts, _key_of(digests[term[pick]], rank)))
                size += len(pick)
                if size >= GATHERED_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    columns = f"ids array<{kind}>, hashes array<long>, sizes array<long>, n_slices long, slices binary"
    return texts.mapInArrow(sign, columns)


@dataclass
class Searches:
    """A block of searches: term ``terms[flat[j]]`` stands in search i for ``starts[i] <= j < starts[i + 1]``."""

    ids: list
    terms: pa.Array
    flat: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None
    records: int = 0
    words: int = 0

    def shrink(self, size: np.ndarray) -> np.ndarray:
        """The length figure m of records of so many terms."""
        return 75 + 25 * size * self.records // self.words

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of per-term values (terms, rows) over the terms of each search, which all have one."""
        return np.add.reduceat(values[self.flat], self.starts[:-1], axis=0)


def saturation(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * n // (1000 * n + 12 * m)


def search_blocks(watched: DataFrame, resource_id: str, canonical_string: str) -> Iterator[Searches]:
    """The searches that have a term, in blocks of bounded size."""
    ids, texts, size = [], [], 0

    def closed() -> Searches | None:
        words = byte_words(pa.array(texts, pa.string()), KINDS, lower=True)
        codes, distinct = words.coded()
        has = np.diff(words.starts) > 0
        return Searches([i for i, h in zip(ids, has) if h], distinct, codes, np.append(0, np.cumsum(np.diff(words.starts)[has])))

    rows = watched.select(F.col(resource_id).alias("id"), F.col(canonical_string).cast("string").alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        if ids and size + len(row["text"]) // 4 > SEARCH_TERMS:
            yield closed()
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"]) // 4 + 1
    if ids:
        yield closed()


def weigh(texts: DataFrame, block: Searches) -> None:
    """Count all records and terms, and the records that hold each term of the block; set its weights."""
    shared = texts.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, _, term, _, distinct = _term_counts(part)
                wanted = pc.fill_null(pc.index_in(distinct, shared.value), -1).to_numpy()[term]
                found = np.bincount(wanted[wanted >= 0], minlength=len(shared.value))
                which = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([[-2, -1], which])), pa.array(np.concatenate([[int((sizes > 0).sum()), int(sizes.sum())], found[which]]))],
                    ["term", "n"])

    counts = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    block.records, block.words = counts.get(-2, 0), counts.get(-1, 0)
    block.weights = np.array(
        [math.floor(1000 * math.log((2 * block.records + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.terms))], dtype=np.int64)


def block_bounds(block: Searches, digests: np.ndarray, sizes: np.ndarray, n_slices: int, data: bytes) -> np.ndarray:
    """Upper bounds (searches, rows) of the scores of one block of signatures.

    A term that a record holds has all its bits, so the AND of its slices overestimates where it is;
    the highest level that is present bounds its occurrences from above, and scores rise with them.
    """
    rows = len(sizes)
    maps = np.frombuffer(data, dtype=np.uint8).reshape(n_slices, -1)
    level = np.zeros((len(digests), rows), dtype=np.int8)
    alive, before = np.arange(len(digests)), None
    for rank in range(len(LEVELS)):
        there = None
        for place in _places(_key_of(digests[alive], rank), n_slices):
            there = maps[place] if there is None else there & maps[place]
        there = there if before is None else there & before
        some = there.any(axis=1)
        alive, before = alive[some], there[some]
        if not len(alive):
            break
        level[alive] += np.unpackbits(before, axis=1, count=rows, bitorder="little").view(np.int8)
    most = np.append(0, np.append(LEVELS[1:] - 1, 0))
    m = block.shrink(sizes)
    high = np.minimum(most[:, None], sizes)
    high[len(LEVELS)] = sizes
    table = saturation(high, m)
    bounds = np.zeros((len(block.ids), rows), dtype=np.int64)
    step = max(1, CELLS // max(len(block.flat), 1))
    for at in range(0, rows, step):
        cut = slice(at, min(at + step, rows))
        values = table[level[:, cut], np.arange(cut.start, cut.stop)] * block.weights[:, None]
        bounds[:, cut] = block.sums(values)
    return bounds


def _signed(batches: Iterator[pa.RecordBatch], block: Searches) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    digests = digests_of_strings(block.terms)
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            sizes = part.column("sizes").flatten().to_numpy()
            yield (part.column("ids").flatten(), part.column("hashes").flatten(),
                   block_bounds(block, digests, sizes, part.column("n_slices")[0].as_py(), part.column("slices")[0].as_py()))


def best_bounds(signatures: DataFrame, block: Searches, top: int) -> DataFrame:
    """(event_id, h, searches): for every search the ``top`` records with the highest bounds."""
    shared = signatures.sparkSession.sparkContext.broadcast(block)
    kind = signatures.schema["ids"].dataType.elementType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held = [np.zeros((len(own.ids), 0), dtype=np.int64), np.zeros((len(own.ids), 0), dtype=np.int64)]
        ids, hashes, total = [], [], 0
        for some, names, bounds in _signed(batches, own):
            both = np.concatenate([held[0], bounds], axis=1)
            number = np.concatenate([held[1], np.broadcast_to(np.arange(total, total + bounds.shape[1]), bounds.shape)], axis=1)
            if both.shape[1] > top:
                pick = np.argpartition(-both, top - 1, axis=1)[:, :top]
                both, number = np.take_along_axis(both, pick, axis=1), np.take_along_axis(number, pick, axis=1)
            # names of the records that are still among the best
            used, place = np.unique(number, return_inverse=True)
            ids = pa.concat_arrays([ids, some]) if total else some
            hashes = pa.concat_arrays([hashes, names]) if total else names
            ids, hashes, total = ids.take(pa.array(used)), hashes.take(pa.array(used)), len(used)
            held = [both, place.reshape(number.shape)]
        search, column = np.nonzero(held[0] > 0)
        if len(search):
            record = pa.array(held[1][search, column])
            yield pa.RecordBatch.from_arrays(
                [ids.take(record), hashes.take(record), pa.array(search), pa.array(held[0][search, column])], ["event_id", "h", "search", "bound"])

    rows = signatures.mapInArrow(best, f"event_id {kind}, h long, search long, bound long")
    order = W.partitionBy("search").orderBy(F.col("bound").desc(), "event_id", "h")
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return first.groupBy("event_id", "h").agg(F.collect_set("search").alias("searches"))


def open_records(signatures: DataFrame, block: Searches, least: list[tuple | None]) -> DataFrame:
    """(event_id, h, searches): the records that the bounds do not exclude.

    ``least`` gives for every search the score and id of the last of the best records known so far, if
    there are enough of them. A record is excluded if its bound is lower, or equal while its id is greater.
    """
    kind = signatures.schema["ids"].dataType.elementType
    limit = np.array([1 if x is None else x[0] for x in least], dtype=np.int64)
    last = [None if x is None else x[1] for x in least]
    known = np.array([x is not None for x in least])
    shared = signatures.sparkSession.sparkContext.broadcast((block, limit, last, known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, limit, last, known = shared.value
        for ids, hashes, bounds in _signed(batches, own):
            search, row = np.nonzero(bounds >= limit[:, None])
            tie = (bounds[search, row] == limit[search]) & known[search]
            if tie.any():
                ends = pa.array(last, ids.type).take(pa.array(search))
                later = pc.fill_null(pc.greater(ids.take(pa.array(row)), ends), False).to_numpy(zero_copy_only=False)
                # null ids come last
                later |= ids.is_null().to_numpy(zero_copy_only=False)[row] & ends.is_valid().to_numpy(zero_copy_only=False)
                search, row = search[~(tie & later)], row[~(tie & later)]
            order = np.argsort(row, kind="stable")
            search, row = search[order], row[order]
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(search))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[head])), hashes.take(pa.array(row[head])), lists], ["event_id", "h", "searches"])

    return signatures.mapInArrow(find, f"event_id {kind.simpleString()}, h long, searches array<long>").distinct()


def exact_scores(texts: DataFrame, candidates: DataFrame, block: Searches) -> DataFrame:
    """(search, event_id, score) of the candidates with a score above 0, from their whole texts."""
    shared = texts.sparkSession.sparkContext.broadcast(block)
    kind = texts.schema["event_id"].dataType.simpleString()
    key = F.struct("event_id", "h").alias("_k")
    # read from a written table, so that Spark knows its size and broadcasts it only below its threshold
    wanted = written(candidates.select(key, "searches"), "search-candidates")
    rows = texts.withColumn("_k", key).join(wanted, "_k").select("event_id", "text", "searches")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, text, term, n, distinct = _term_counts(part)
                wanted = pc.fill_null(pc.index_in(distinct, own.terms), -1).to_numpy()[term]
                hit = wanted >= 0
                text, wanted, n = text[hit], wanted[hit], n[hit]
                gain = own.weights[wanted] * saturation(n, own.shrink(sizes)[text])
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                found = []
                for i, searches in enumerate(part.column("searches").to_pylist()):
                    values = np.zeros(len(own.terms), dtype=np.int64)
                    values[wanted[bounds[i]:bounds[i + 1]]] = gain[bounds[i]:bounds[i + 1]]
                    totals = own.sums(values)
                    found += [(s, i, int(totals[s])) for s in searches if totals[s] > 0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found], pa.int64()), part.column("event_id").take(pa.array([f[1] for f in found], pa.int64())),
                    pa.array([f[2] for f in found], pa.int64())], ["search", "event_id", "score"])

    return rows.mapInArrow(score, f"search long, event_id {kind}, score long")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("search").orderBy(F.col("score").desc(), F.col("event_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_events(
    payloads: DataFrame, watched: DataFrame, event_id: str = "event_id", canonical_string: str = "canonical_string",
    resource_id: str = "resource_id", top: int = 20,
) -> DataFrame:
    """The ``top`` records with the highest scores for every row of ``watched``.

    ``payloads`` are records with an id (integer or text) and a text, such as the canonical strings of
    alerts; ``watched`` rows name a resource and, under the same column name as the payloads, the text that is looked for. Returns ``resource_id``,
    ``rank`` (from 1), ``event_id``, ``score`` (integer, above 0); equal scores by ascending id, null ids last.

    A term is a run of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. The score is
    a sum over the terms of the search, repeats included: weight of the term (from the share of records
    that hold it) times its saturated occurrences, all in 64-bit integers.

    All records get a Bloom signature of their terms; signatures are kept bit-sliced, so the AND of a few slices
    says for a whole block of records where a term may be, and how often at most. Weighted sums over the terms
    bound every score from above. The records with the highest bounds are scored first; then exactly those
    are scored from their texts that the last of the best so far does not exclude. Nothing is lost to a
    false positive, and equal scores are told apart by id. Searches are taken in blocks of bounded size.

    Null and empty texts have no terms: such searches give no rows and such records are never found. Repeated
    records and repeated searches count each for itself (a repeated search by its row). Other columns are ignored.
    """
    spark = payloads.sparkSession
    texts = payloads.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("h", F.xxhash64("text"))
    kind, named = texts.schema["event_id"].dataType.simpleString(), watched.schema[resource_id].dataType.simpleString()
    found = spark.createDataFrame([], f"resource_id {named}, rank int, event_id {kind}, score long")
    signatures = None
    for block in search_blocks(watched, resource_id, canonical_string):
        if not block.ids:
            continue
        weigh(texts, block)
        if not block.records:
            break
        signatures = written(build_signatures(texts), "signatures") if signatures is None else signatures
        first = _ranked(exact_scores(texts, best_bounds(signatures, block, top), block), top).where(F.col("rank") == top)
        known = {r["search"]: (r["score"], r["event_id"]) for r in first.collect()}  # one row a search of the block
        candidates = open_records(signatures, block, [known.get(i) for i in range(len(block.ids))])
        ranked = _ranked(exact_scores(texts, candidates, block), top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"search long, resource_id {named}")
        found = found.unionByName(ranked.join(F.broadcast(names), "search").select("resource_id", "rank", "event_id", "score"))
    return found
