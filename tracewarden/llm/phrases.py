"""Collocations by multikey quicksort of suffix pointers, routed by their leading words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import byte_kinds, byte_words, digests_of, scramble, string_buffers
from .filters import name_filter
from .storage import written
from .text import slices
from .urls import BlockedBloom

#: Words lie between these, and no phrase crosses one of those.
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
NO_CATEGORY = "und"
FILTER_BITS, FILTER_BYTES = 16, 16 << 20
#: Suffixes that one route holds, about; and texts of the sample that finds the leading words to split.
ROUTE_WORDS, SAMPLE_TEXTS = 2_000_000, 20_000
#: No more than this many prefixes of one length are split.
MOST_HOT = 1 << 15
SLICE_CHARS = 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def text_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Of every word of a slice: its category's number and its code; then the categories, pieces and words."""
    words = byte_words(part.column("text"), KINDS, lower=True)
    codes, distinct = words.coded()
    kinds = part.column("category").dictionary_encode()
    text = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
    return kinds.indices.to_numpy()[text], codes, kinds.dictionary, words.breaks + text, distinct


def words_of_categories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(category, word, n) of every slice, and with a null word all words of the category."""
    for batch in batches:
        for part in slices(batch, "text"):
            kind, code, kinds, _, distinct = text_words(part)
            both, n = np.unique(kind * np.int64(len(distinct)) + code, return_counts=True)
            total = np.bincount(kind, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([kinds.take(pa.array(both // max(len(distinct), 1))), kinds]),
                pa.concat_arrays([distinct.take(pa.array(both % max(len(distinct), 1))).cast(pa.string()), pa.nulls(len(kinds), pa.string())]),
                pa.array(np.append(n, total))], ["category", "word", "n"])


def digests_of_strings(values: pa.Array) -> np.ndarray:
    bounds, data = string_buffers(values.cast(pa.large_string()))
    return digests_of(data, bounds[:-1], bounds[1:])


def _filter_of(found: DataFrame, size: int) -> BlockedBloom:
    """A filter of phrases (category, phrase) of so many words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ").flatten()
            each = digests_of_strings(words).reshape(batch.num_rows, size)
            name = digests_of_strings(batch.column("category"))
            for d in range(size):
                name = _longer(name, each[:, d])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64))], ["name"])

    return name_filter(found.select("category", "phrase").mapInArrow(digest, "name long"), FILTER_BITS, FILTER_BYTES)


def _longer(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The digest of a prefix and one more word."""
    with np.errstate(over="ignore"):
        return scramble(name * _STEP + word)


class Suffixes:
    """The distinct suffixes of a slice, of ``shortest`` to ``longest`` words: ``codes`` (n, longest) from 1,
    0 behind the end, with category, weight and the digests of all their prefixes.

    A suffix ends with its piece, or before the first word that makes up an infrequent phrase of ``size`` words
    (1 or 2) with those before it.
    """

    def __init__(self, part: pa.RecordBatch, shortest: int, longest: int, frequent: BlockedBloom, size: int):
        kind, code, self.kinds, piece, self.words = text_words(part)
        n, total = len(code), np.int64(max(len(self.words), 1))
        word, kinds = digests_of_strings(self.words), digests_of_strings(self.kinds)
        ends = np.ones(n, dtype=bool)  # nothing follows in this suffix
        if size == 1 and n:
            both, place = np.unique(kind * total + code, return_inverse=True)
            held = frequent.holds(_longer(kinds[both // total], word[both % total]).view(np.int64))[place]
            ends[:-1] = (piece[1:] != piece[:-1]) | ~held[1:] | ~held[:-1]
        elif n:
            near = np.flatnonzero(piece[1:] == piece[:-1])
            both, place = np.unique((kind[near] * total + code[near]) * total + code[near + 1], return_inverse=True)
            name = _longer(_longer(kinds[both // total // total], word[both // total % total]), word[both % total])
            ends[near] = ~frequent.holds(name.view(np.int64))[place]
        left = np.zeros(n, dtype=np.int8)  # words after this one, up to longest
        for _ in range(longest - 1):
            left[:-1] = np.where(ends[:-1], 0, left[1:] + 1)
        at = np.flatnonzero(left >= shortest - 1)
        table = np.zeros((len(at), longest), dtype=np.int64)
        for d in range(longest):
            there = left[at] >= d
            table[there, d] = code[at[there] + d] + 1
        # one row for equal suffixes; 21 bits hold every code of a slice
        keys = [kind[at].astype(np.int64)]
        for d in range(0, longest, 3):
            keys.append(sum((table[:, d + i] << np.int64(21 * (2 - i)) for i in range(min(3, longest - d))), np.zeros(len(at), dtype=np.int64)))
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        heads = np.flatnonzero(new)
        self.weights = np.diff(np.append(heads, len(at)))
        self.codes, self.kind = table[order[heads]], kind[at[order[heads]]]
        self.prefixes, name = np.zeros((len(heads), longest), dtype=np.uint64), kinds[self.kind]
        for d in range(longest):
            name = _longer(name, word[np.maximum(self.codes[:, d] - 1, 0)]) if len(heads) else name
            self.prefixes[:, d] = np.where(self.codes[:, d] > 0, name, 0)


def hot_prefixes(texts: DataFrame, longest: int, suffixes, share: float) -> np.ndarray:
    """Digests of the prefixes that begin more than ``share`` of all suffixes, by a sample of texts.

    They only decide how suffixes are dealt; counts do not depend on them.
    """
    part = min(1.0, SAMPLE_TEXTS / max(texts.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_CHARS):
                own = suffixes(piece)
                names = own.prefixes[:, :longest - 1].ravel()
                weight = np.repeat(own.weights, longest - 1)
                names, place = np.unique(np.append(names, np.uint64(0)), return_inverse=True)
                n = np.bincount(place, weights=np.append(weight, 0), minlength=len(names)).astype(np.int64)
                n[0] = own.weights.sum()  # name 0 stands for all suffixes
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])

    counts = written(texts.sample(part, 11).mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "phrase-prefixes")
    total = counts.where("name = 0").select("n").first()
    # every suffix has one prefix of a length, so there are at most longest / share of them
    found = counts.where((F.col("name") != 0) & (F.col("n") > share * (total["n"] if total else 0))).select("name").collect()
    return np.sort(np.array([r["name"] for r in found], dtype=np.int64).view(np.uint64))


def equal_partitions(table: np.ndarray, weights: np.ndarray, hot: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Three-way multikey quicksort of suffix pointers: (a pointer, total weight, depth) of every equal partition.

    ``table`` (n, longest) holds word codes from 1, 0 behind the end. All partitions of one depth are
    split at the same time: each by a pivot of its own into pointers with a smaller, an equal and a
    greater word. Equal parts are done at this depth and go on to the next one. A part of less weight than
    ``least`` is abandoned, unless ``hot`` says that its prefix is spread over several tables.
    """
    pointers = np.arange(len(table))
    group = np.zeros(len(table), dtype=np.int64)  # rises; equal for pointers of one partition
    for depth in range(table.shape[1]):
        words = table[pointers, depth]
        there = words > 0
        pointers, group, words = pointers[there], group[there], words[there]
        done_pointers, done_group, count = [], [], 0
        while len(pointers):
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(head, len(group)))
            dense = np.repeat(np.arange(len(head)), sizes)
            pivot = words[head + sizes // 2][dense]
            side = np.where(words < pivot, 0, np.where(words == pivot, 1, 2))
            part = dense * 3 + side
            weight = np.bincount(part, weights=weights[pointers], minlength=3 * len(head))
            spread = np.bincount(part[hot[pointers] > depth], minlength=3 * len(head)) > 0
            stays = ((weight >= least) | spread)[part]
            equal = stays & (side == 1)
            if equal.any():
                done_pointers.append(pointers[equal])
                done_group.append(dense[equal] + count)
                count += len(head)
            rest = np.flatnonzero(stays & (side != 1))
            rest = rest[np.argsort(part[rest], kind="stable")]
            pointers, group, words = pointers[rest], part[rest], words[rest]
        if not done_pointers:
            return
        pointers, group = np.concatenate(done_pointers), np.concatenate(done_group)
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        yield pointers[head], np.add.reduceat(weights[pointers], head), depth + 1


def count_phrases(texts: DataFrame, found: DataFrame, size: int, words: int, longest: int, least: int) -> DataFrame:
    """(category, phrase, size, n): every phrase of more than ``size`` and up to ``longest`` words with
    ``least`` occurrences or more. ``found`` has those of ``size`` words."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(_filter_of(found, size))
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // ROUTE_WORDS))

    def suffixes(part: pa.RecordBatch) -> Suffixes:
        return Suffixes(part, size + 1, longest, frequent.value, size)

    hot = spark.sparkContext.broadcast(hot_prefixes(texts, longest, suffixes, max(0.25 / routes, 1 / MOST_HOT)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                own = suffixes(part)
                n = len(own.weights)
                if not n:
                    continue
                hits = np.zeros(n, dtype=np.int64)
                if len(hot.value):
                    near = hot.value[np.minimum(np.searchsorted(hot.value, own.prefixes), len(hot.value) - 1)]
                    hits = np.cumprod((near == own.prefixes) & (own.codes > 0), axis=1).sum(axis=1)
                depth = np.minimum(hits, (own.codes > 0).sum(axis=1) - 1)
                route = (own.prefixes[np.arange(n), depth] % np.uint64(routes)).astype(np.int64)
                order = np.lexsort((hits, own.kind, route))
                where = np.stack([route[order], own.kind[order], hits[order]])
                head = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(axis=0)))
                rows = []
                for a, b in zip(head.tolist(), np.append(head[1:], n).tolist()):
                    codes = own.codes[order[a:b]]
                    used, small = np.unique(np.append(0, codes), return_inverse=True)
                    small = small[1:].astype("<u2" if len(used) <= 65536 else "<u4")
                    # column by column: sorted suffixes then shuffle as few bytes
                    rows.append((used[1:] - 1, small.reshape(b - a, longest).T.tobytes(), own.weights[order[a:b]].astype("<u4").tobytes()))
                used = np.concatenate([r[0] for r in rows])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(r[0]) for r in rows])), pa.int32()), own.words.take(pa.array(used)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(where[0, head]), own.kinds.take(pa.array(where[1, head])), pa.array(where[2, head]), lists,
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["route", "category", "hot", "words", "codes", "weights"])

    def sort(group: pa.Table) -> pa.Table:
        lists = group.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        number = np.append(0, coded.indices.to_numpy() + 1)  # 0 stays the end of a suffix
        bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        tables, weights, hits = [], [], []
        for i, (codes, weight, hit) in enumerate(zip(*(group.column(c).to_pylist() for c in ("codes", "weights", "hot")))):
            n = len(weight) // 4
            own = np.frombuffer(codes, dtype="<u2" if len(codes) == 2 * n * longest else "<u4").astype(np.int64)
            tables.append(np.where(own > 0, number[own + bounds[i]], 0).reshape(longest, n).T.astype(np.int32))
            weights.append(np.frombuffer(weight, dtype="<u4").astype(np.int64))
            hits.append(np.full(n, hit, dtype=np.int8))
        table, names, phrases, sizes, counts = np.concatenate(tables), coded.dictionary.to_pylist(), [], [], []
        for pointers, total, depth in equal_partitions(table, np.concatenate(weights), np.concatenate(hits), least):
            if depth > size:
                phrases += [" ".join(names[c - 1] for c in row) for row in table[pointers, :depth].tolist()]
                sizes += [depth] * len(pointers)
                counts += total.tolist()
        kind = pa.array([group.column("category")[0].as_py()] * len(phrases), pa.string())
        return pa.table([kind, pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["category", "phrase", "size", "n"])

    sent = texts.mapInArrow(send, "route long, category string, hot long, words array<string>, codes binary, weights binary")
    parts = sent.groupBy("route", "category").applyInArrow(sort, "category string, phrase string, size int, n long")
    # the parts of a hot prefix come from several routes
    return parts.groupBy("category", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mine_phrases(
    payloads: DataFrame, canonical_string: str = "canonical_string", category: str = "threat_category", longest: int = 5, least: int = 100,
    top: int = 2000,
) -> DataFrame:
    """Phrases whose words stand together more often than apart, per category.

    ``payloads`` are records with a text and a category, such as the canonical strings of alerts under
    their threat category. Texts are cut at ``.,;:!?`` and line breaks into pieces and those at
    spaces and tabs into words, A-Z lower-cased. Returns ``category``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``,
    ``score``: the first ``top`` phrases of 2 to ``longest`` words with ``least`` occurrences or more. ``n`` counts
    the words of the category, ``a`` the phrase, ``l`` and ``r`` the parts of the cut with the lowest score
    floor(1000 a n / (l r)). A phrase goes if a longer one that holds it occurs as often.

    Words are counted first. Suffixes of texts are then routed by their leading words, by one word where that
    suffices and by more where a prefix begins a large share of all suffixes; equal suffixes of a task
    travel as one. A route sorts its suffixes by multikey quicksort and abandons partitions that are
    too small. The sort goes to two words first, and to ``longest`` words for the suffixes whose pairs were not
    abandoned, so most suffixes travel as two words. What the tasks share is a Bloom filter of
    frequent words, then of frequent pairs (16 MB at most; what it lets pass in vain is only counted and dropped),
    and the prefixes that are split.

    Null texts are empty, a null category is ``und``, as is a category of that name. Repeated records all count.
    Other columns are ignored; an empty table gives no rows. Counts must fit 64 bits and products 38 digits.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    texts = payloads.select(
        F.coalesce(F.col(category).cast("string"), F.lit(NO_CATEGORY)).alias("category"), F.col(canonical_string).cast("string").alias("text"))
    counted = texts.mapInArrow(words_of_categories, "category string, word string, n long").groupBy("category", "word").agg(F.sum("n").alias("n"))
    counted = written(counted.where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counted.where("word is null").select("category", F.col("n").alias("total"))
    frequent = counted.where("word is not null").select("category", F.col("word").alias("phrase"), "n")
    everything = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    found = written(count_phrases(texts, frequent, 1, everything, 2, least), "phrases")
    if longest > 2:
        found = found.unionByName(written(count_phrases(texts, found, 2, everything, longest, least), "phrases"))

    words = F.split("phrase", " ")
    shorter = F.explode(F.array(*(F.array_join(F.slice(words, start, F.col("size") - 1), " ") for start in (1, 2))))
    # a phrase inside one that is longer by two occurs at least as often as the one between them
    inside = found.where("size > 2").select("category", shorter.alias("phrase"), F.col("n").alias("longer"))
    inside = inside.groupBy("category", "phrase").agg(F.max("longer").alias("longer"))
    open_ = found.join(inside, ["category", "phrase"], "left").where("longer is null or longer < n")

    counts = found.select("category", "phrase", "n").unionByName(frequent)
    cuts = open_.select("category", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumns({
        "_l": F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "),
        "_r": F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " ")})
    for side in ("l", "r"):
        cuts = cuts.join(counts.select("category", F.col("phrase").alias(f"_{side}"), F.col("n").alias(side)), ["category", f"_{side}"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "total")}
    scored = cuts.join(totals, "category").withColumn("_up", F.lit(1000).cast("decimal(4,0)") * wide["a"]).withColumns({
        "_up": F.col("_up").cast("decimal(19,0)") * wide["total"], "_down": wide["l"] * wide["r"]})
    scored = scored.withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("category", "phrase", "a", F.col("total").alias("n")).agg(
        F.array_min(F.collect_list(F.struct("score", "cut", "l", "r"))).alias("b"))  # one row a cut
    best = best.select("category", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = W.partitionBy("category").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("category", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
