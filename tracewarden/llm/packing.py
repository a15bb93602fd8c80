"""Packing token pieces into fixed-length sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import encoded
from .storage import written

RANK_BUCKETS = 64


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) with their counts for a histogram {length: count}.

    Lengths are placed longest first. All open packs of one pattern are one entry with a count; a
    length goes to the fullest-room pattern, that is the shortest pack, if it fits there, else it
    opens packs of its own. The number of patterns is bounded by lengths, not by records.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = capacity - sum(pattern)
        (by_room.setdefault(room, []) if room else done).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                most = capacity // length  # packs of this length alone, as full as it allows
                if left >= most:
                    put((length,) * most, left // most)
                    left %= most
                if left:
                    put((length,) * left, 1)
                break
            pattern, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(count, left)
            put((*pattern, length), used)
            if count > used:
                put(pattern, count - used)
            left -= used
    return done + [entry for entries in by_room.values() for entry in entries]


def cut_pieces(
    payloads: DataFrame, tokenizer: str, event_id: str = "event_id", canonical_string: str = "canonical_string",
    sequence_tokens: int = 2048, end_id: int = 1, spaced: bool = True,
) -> DataFrame:
    """Token pieces of at most ``sequence_tokens`` ids: ``event_id``, ``start``, ``length``,
    ``ids_crc32``, ``event_tokens``.

    A text longer than a sequence is cut into whole sequences and a rest. Null text: the end id alone.
    """
    slim = payloads.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"))
    kind = slim.schema["event_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, tokens in encoded(batches, tokenizer, spaced, end_id, "text"):
            wide, sizes = tokens.astype("<u4"), np.diff(starts)
            pieces = -(-sizes // sequence_tokens)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = number * sequence_tokens
            length = np.minimum(sizes[row] - begin, sequence_tokens)
            at = starts[row] + begin
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([
                part.column("event_id").take(pa.array(row)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(sizes[row])], ["event_id", "start", "length", "ids_crc32", "event_tokens"])

    return slim.mapInArrow(cut, f"event_id {kind}, start long, length long, ids_crc32 long, event_tokens long")


def pack_events(
    payloads: DataFrame, tokenizer: str, event_id: str = "event_id", canonical_string: str = "canonical_string",
    sequence_tokens: int = 2048, end_id: int = 1, spaced: bool = True,
) -> DataFrame:
    """Pack every payload text (such as the canonical strings of the alerts) into sequences.

    Returns one row per piece: ``event_id``, ``start`` (ids of its text before it), ``length``,
    ``ids_crc32``, ``event_tokens`` (ids of the text with the end id), ``sequence_id`` and ``offset``
    in the sequence; other columns are ignored. Only the histogram of at most ``sequence_tokens``
    lengths comes to the driver; patterns go back as a table and meet the pieces by (length, rank).
    Ranks are counted in hash buckets of ``event_id`` that are sized by row count, so one very common
    length does not meet in one task.

    Every id lies in exactly one piece. Rows that share an id are packed each for itself; null ids are
    kept. Full pieces are sequences of their own. An empty table gives no rows.
    """
    pieces = written(cut_pieces(payloads, tokenizer, event_id, canonical_string, sequence_tokens, end_id, spaced), "pieces")
    spark = pieces.sparkSession
    # enough buckets that a length of all rows still has about 20,000 rows in each
    buckets = max(RANK_BUCKETS, pieces.count() // 20_000)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("event_id", "start"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, sequence_tokens)

    first, rows, taken = 0, [], dict.fromkeys(histogram, 0)
    for lengths, count in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            repeat = lengths.count(length)
            # ranks taken[length] .. + repeat * count belong to this pattern, repeat of them to each sequence
            rows.append((length, taken[length], taken[length] + repeat * count, repeat, first, offset))
            taken[length] += repeat * count
            offset += repeat * length
        first += count
    slots = spark.createDataFrame(rows, "length long, low long, high long, repeat long, first long, at long")
    # at most sequence_tokens rows, and as many patterns as the driver has just built
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "repeat", "first", "at"))).alias("slots"))

    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "_bucket").orderBy("event_id", "start", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).join(F.broadcast(slots), "length")
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"]))[0]
    placed = ranked.withColumn("_slot", slot).withColumn("_in", F.col("_rank") - F.col("_slot.low"))
    return placed.select(
        "event_id", "start", "length", "ids_crc32", "event_tokens",
        (F.col("_slot.first") + F.floor(F.col("_in") / F.col("_slot.repeat"))).cast("long").alias("sequence_id"),
        (F.col("_slot.at") + F.pmod(F.col("_in"), F.col("_slot.repeat")) * F.col("length")).cast("long").alias("offset"),
    )
