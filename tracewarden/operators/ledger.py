"""Batches, Merkle roots, hash-linked blocks and the append-only log as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BATCH_SIZE, GENESIS_HASH
from ..functions.digests import sha256_hex
from ..functions.merkle import merkle_levels, merkle_proof, merkle_root
from ..functions.text import json_string, parse_rfc3339
from .distributed import pin, row_positions

SEGMENT_BLOCKS = 1024


# --- batches -----------------------------------------------------------------------------------
def assign_batches(
    df: DataFrame, order: str, chain: list[str] | None = None, size: int = BATCH_SIZE
) -> DataFrame:
    """Add ``batch_no`` and ``leaf_index`` by arrival order per chain; the last batch may be partial.

    Ranks are taken per (chain, range of ids), so one chain may hold any share of the rows.
    """
    ranked = row_positions(df, order, chain or [], "_position")
    return ranked.withColumns({
        "batch_no": F.floor(F.col("_position") / size).cast("long"),
        "leaf_index": (F.col("_position") % size).cast("long"),
    }).drop("_position", "_position_total")


def _leaves(digest: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct("leaf_index", F.col(digest).alias("d"))))
    return F.transform(pairs, lambda p: p["d"])


def batch_roots(df: DataFrame, digest: str, chain: list[str] | None = None) -> DataFrame:
    """(chain, batch_no, record_count, merkle_root). A group never exceeds the batch size."""
    grouped = df.groupBy(*(chain or []), "batch_no").agg(_leaves(digest).alias("leaves"))
    return grouped.select(
        *(chain or []), "batch_no", F.size("leaves").cast("long").alias("record_count"),
        merkle_root(F.col("leaves")).alias("merkle_root"),
    )


def batch_proofs(df: DataFrame, digest: str, chain: list[str] | None = None) -> DataFrame:
    """(chain, batch_no, leaf_index, leaf, merkle_root, proof), one row per leaf.

    The padded levels are computed once per batch and stay inside the batch row until every leaf's
    path has been read from them.
    """
    grouped = df.groupBy(*(chain or []), "batch_no").agg(_leaves(digest).alias("leaves")).withColumns({
        "levels": merkle_levels(F.col("leaves")), "merkle_root": merkle_root(F.col("leaves")),
    })
    paths = F.transform(
        "leaves",
        lambda leaf, i: F.struct(i.cast("long").alias("leaf_index"), leaf.alias("leaf"),
                                 merkle_proof(F.col("levels"), i).alias("proof")),
    )
    return grouped.select(*(chain or []), "batch_no", "merkle_root", F.inline(paths)).select(
        *(chain or []), "batch_no", "leaf_index", "leaf", "merkle_root", "proof"
    )


# --- hash links --------------------------------------------------------------------------------
def _block_text(chain: Column, number: Column, root: Column, count: Column) -> tuple[Column, Column]:
    """The block's canonical JSON (members in key order) up to its previous hash, and from there on."""
    before = F.concat(
        F.lit('{"chain":'), json_string(chain), F.lit(',"index":'), number.cast("string"),
        F.lit(',"merkle_root":"'), root, F.lit('","previous_hash":"'),
    )
    return before, F.concat(F.lit('","record_count":'), count.cast("string"), F.lit("}"))


def block_hash(chain: Column, number: Column, previous: Column, root: Column, count: Column) -> Column:
    """SHA-256 of the block's canonical JSON."""
    before, after = _block_text(chain, number, root, count)
    return sha256_hex(F.concat(before, previous, after))


def segment_genesis(chain: Column, segment: Column) -> Column:
    """What the first tip of a spine links to: all zeros for spine 0, else a derived value."""
    derived = sha256_hex(F.concat(F.lit('{"chain":'), json_string(chain), F.lit(',"segment":'), segment.cast("string"), F.lit("}")))
    return F.when(segment == 0, F.lit(GENESIS_HASH)).otherwise(derived)


def _linker(chain: str, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, started = None, None, False
        for batch in batches:
            previous, own = [], []
            for name, start, before, after in zip(*(batch.column(c).to_pylist() for c in (chain, "_start", "_before", "_after"))):
                if not started or name != current:
                    current, last, started = name, start, True
                previous.append(last)
                whole = last is not None and before is not None and after is not None
                last = hashlib.sha256((before + last + after).encode()).hexdigest() if whole else None
                own.append(last)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(previous, pa.string()), pa.array(own, pa.string())], [*kept, "previous_hash", "hash"])

    return run


def link_blocks(
    roots: DataFrame, chain: str, number: str = "block_number", segment_blocks: int = SEGMENT_BLOCKS,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Hash-link the batch roots of every chain: each block holds the hash of the one before it.

    Linking is sequential by nature, so what is linked are roots, never events. The blocks of a chain pass one task in order,
    as a stream of which it holds an Arrow batch and the last hash; chains are linked in parallel. ``segment`` numbers runs of
    ``segment_blocks`` blocks, which ``verify_chain`` checks in parallel and ``segment_spine`` sums up; links do not stop at them.
    ``heads`` (chain, next_block, head_hash) continues chains already in the log.
    """
    base = roots
    if heads is not None:
        base = base.join(heads, chain, "left").withColumn(
            number, F.col(number) + F.coalesce(F.col("next_block"), F.lit(0))
        )
    else:
        base = base.withColumn("head_hash", F.lit(None).cast("string"))
    before, after = _block_text(F.col(chain), F.col(number), F.col("merkle_root"), F.col("record_count"))
    kept = [chain, "segment", number, "merkle_root", "record_count"]
    told = base.withColumn("segment", F.floor(F.col(number) / segment_blocks)).select(
        *kept, F.when(F.col(number) == 0, F.lit(GENESIS_HASH)).otherwise(F.col("head_hash")).alias("_start"),
        before.alias("_before"), after.alias("_after"),
    )
    ordered = told.repartition(chain).sortWithinPartitions(chain, number, "merkle_root", "record_count")
    linked = T.StructType([T.StructField(f.name, f.dataType) for f in told.select(*kept).schema])
    return ordered.mapInArrow(_linker(chain, kept), linked.add("previous_hash", "string").add("hash", "string"))


def _fold(heads: DataFrame, chain: str, width: int) -> DataFrame:
    """Link (chain, position, head_hash) rows in groups of ``width`` consecutive positions."""
    groups = heads.withColumn("spine", F.floor(F.col("position") / width)).groupBy(chain, "spine").agg(
        F.array_sort(F.collect_list(F.struct("position", "head_hash"))).alias("tips"))
    groups = groups.withColumn("start", segment_genesis(F.col(chain), F.col("spine")))
    empty = F.array().cast("array<string>")

    def append(acc: Column, tip: Column) -> Column:
        previous = F.when(F.size(acc) == 0, F.col("start")).otherwise(F.element_at(acc, -1))
        return F.concat(acc, F.array(sha256_hex(F.concat(previous, tip["head_hash"]))))

    return groups.withColumn("links", F.aggregate("tips", empty, append)).select(
        chain, "spine", F.inline(F.arrays_zip("tips", "links"))
    ).select(chain, "spine", F.col("tips.position").alias("position"), F.col("tips.head_hash").alias("head_hash"),
             F.col("links").alias("spine_hash"))


def _segment_heads(blocks: DataFrame, chain: str, number: str) -> DataFrame:
    return blocks.groupBy(chain, F.col("segment").alias("position")).agg(F.max_by("hash", number).alias("head_hash"))


def segment_spine(blocks: DataFrame, chain: str, number: str = "block_number", width: int = SEGMENT_BLOCKS) -> DataFrame:
    """(chain, spine, segment, head_hash, spine_hash): the last hash of each segment, linked in order.

    A spine covers ``width`` segments, so no group grows with the chain; ``chain_seal`` goes on upward.
    """
    return _fold(_segment_heads(blocks, chain, number), chain, width).withColumnRenamed("position", "segment")


def chain_seal(
    blocks: DataFrame, chain: str, number: str = "block_number", width: int = SEGMENT_BLOCKS, levels: int = 3
) -> DataFrame:
    """(chain, seal): one hash that commits to a whole chain of up to width^levels segments.

    Every level folds the ends of the level below in groups of ``width``.
    """
    heads = _segment_heads(blocks, chain, number)
    for _ in range(levels):
        folded = _fold(heads, chain, width)
        heads = folded.groupBy(chain, F.col("spine").alias("position")).agg(F.max_by("spine_hash", "position").alias("head_hash"))
    return heads.groupBy(chain).agg(
        F.when(F.count("*") == 1, F.max("head_hash")).otherwise(F.raise_error(F.lit("chain too long: raise levels"))).alias("seal"))


def verify_chain(
    blocks: DataFrame, chain: str, number: str = "block_number", segment_blocks: int = SEGMENT_BLOCKS
) -> DataFrame:
    """Blocks with ``hash_ok`` (own hash recomputes) and ``link_ok`` (previous hash matches).

    Parallel over segments: the window is bounded by the segment size, and the last block of a segment is sent to the
    next one as well, whose first block links to it. The stored hash is compared, so an edited last block is found too.
    """
    segment = F.floor(F.col(number) / segment_blocks)
    closes = (F.col(number) + 1) % segment_blocks == 0
    sent = blocks.withColumn("_segment", F.explode(F.when(closes, F.array(segment, segment + 1)).otherwise(F.array(segment))))
    order = W.partitionBy(chain, "_segment").orderBy(number)
    own = block_hash(F.col(chain), F.col(number), F.col("previous_hash"), F.col("merkle_root"), F.col("record_count"))
    before, before_no = F.lag("hash").over(order), F.lag(number).over(order)
    opens = F.col(number) == 0
    expected = F.when(opens, F.lit(GENESIS_HASH)).otherwise(before)
    adjacent = opens | (before_no == F.col(number) - 1)
    met = sent.withColumn("link_ok", F.coalesce((expected == F.col("previous_hash")) & adjacent, F.lit(False)))
    return met.where(F.col("_segment").eqNullSafe(segment)).drop("_segment").withColumn(
        "hash_ok", F.coalesce(own == F.col("hash"), F.lit(False))
    ).select(*blocks.columns, "hash_ok", "link_ok")


def chain_status(checked: DataFrame, chain: str) -> DataFrame:
    return checked.groupBy(chain).agg(
        F.count("*").alias("blocks"), F.count_if(~F.col("hash_ok")).alias("bad_hashes"),
        F.count_if(~F.col("link_ok")).alias("bad_links"),
        F.bool_and(F.col("hash_ok") & F.col("link_ok")).alias("intact"),
    )


def chain_heads(blocks: DataFrame, chain: str, number: str = "block_number") -> DataFrame:
    """Where each chain continues: (chain, next_block, head_hash)."""
    return blocks.groupBy(chain).agg(
        (F.max(number) + 1).alias("next_block"), F.max_by("hash", number).alias("head_hash")
    )


# --- log operations ----------------------------------------------------------------------------
def append_new(batch: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that may be appended: the first of each id in the batch, unless the log has the id."""
    first = batch.groupBy(key).agg(F.min(F.struct(order, *[c for c in batch.columns if c not in (key, order)])).alias("r"))
    return pin(first.select(key, "r.*").select(*batch.columns)).join(log.select(key), key, "left_anti")


def with_reject_reason(batch: DataFrame, settled: DataFrame | None, key: str, order: list) -> DataFrame:
    """Every row of a batch with ``reason``, null for the rows that may be appended.

    Of the rows of one id the first by ``order`` is taken and the others are repeats; an id that is
    settled already is refused altogether. No row disappears.
    """
    first = F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1
    told = batch.withColumn("reason", F.when(~first, "repeated in the batch"))
    if settled is None:
        return told
    known = settled.select(key).distinct().withColumn("_settled", F.lit(True))
    told = told.join(known, key, "left").withColumn("reason", F.when(F.col("_settled"), "already settled").otherwise(F.col("reason")))
    return told.select(*batch.columns, "reason")


def event_history(
    log: DataFrame, timestamp: str = "timestamp", resource: Column | None = None, start=None, end=None
) -> DataFrame:
    """Inclusive range and resource filter. A text column is compared as the time it states, so ``Z`` and
    ``+00:00`` are one instant; a timestamp column is filtered as it is, which reaches the scan."""
    out = log if resource is None else log.where(resource)
    as_text = isinstance(log.schema[timestamp].dataType, T.StringType)
    at = parse_rfc3339(F.col(timestamp)) if as_text else F.col(timestamp)
    bound = lambda x: parse_rfc3339(x if isinstance(x, Column) else F.lit(x)) if as_text and isinstance(x, (str, Column)) else x
    if start is not None:
        out = out.where(at >= bound(start))
    if end is not None:
        out = out.where(at <= bound(end))
    return out


def verify_events(requests: DataFrame, log: DataFrame, key: str = "event_id", digest: str = "payload_digest") -> DataFrame:
    """Requests with ``verified``: the stored digest equals the claimed one. Unknown ids are false, and so
    is an id that the log holds with several digests; a repeated id never repeats a request."""
    stored = log.groupBy(key).agg(F.min(digest).alias("_stored"), (F.min(digest) == F.max(digest)).alias("_one"))
    return requests.join(stored, key, "left").withColumn(
        "verified", F.coalesce((F.col(digest) == F.col("_stored")) & F.col("_one"), F.lit(False))
    ).drop("_stored", "_one")


def unauthorised_writes(records: DataFrame, registry: DataFrame, agent: str = "agent_id") -> DataFrame:
    return records.join(registry.select(agent).distinct(), agent, "left_anti")


def authorised_writes(records: DataFrame, registry: DataFrame, agent: str = "agent_id") -> DataFrame:
    return records.join(registry.select(agent), agent, "left_semi")


def handoff_map(source: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, source_digest, target_digest) for ids on both sides."""
    return source.select(key, F.col("digest").alias("source_digest")).join(
        target.select(key, F.col("digest").alias("target_digest")), key
    )


def handoff_diff(source: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """Which rows changed between two stages: added, removed or altered."""
    joined = source.select(key, F.col("digest").alias("source_digest")).join(
        target.select(key, F.col("digest").alias("target_digest")), key, "full_outer"
    )
    changed = joined.where(~F.col("source_digest").eqNullSafe(F.col("target_digest")))
    return changed.withColumn(
        "change", F.when(F.col("source_digest").isNull(), "added").when(F.col("target_digest").isNull(), "removed").otherwise("altered")
    )


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
