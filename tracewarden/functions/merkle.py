"""Merkle roots, inclusion proofs and their check, as array expressions.

Leaves are hex digests in batch order. Pairs are hashed as raw bytes, an odd level repeats its last
node, and a single leaf is its own root. Arrays are bounded by the batch size, never by the table.
Leaves and inner nodes are not domain-separated, which keeps the format compatible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 32


def _hash_pair(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(left, right), 256))


def _pad(level: Column) -> Column:
    odd = (F.size(level) > 1) & (F.size(level) % 2 == 1)
    return F.when(odd, F.concat(level, F.slice(level, -1, 1))).otherwise(level)


def _parents(padded: Column) -> Column:
    half = (F.size(padded) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), half - 1),
        lambda i: _hash_pair(F.get(padded, i * 2), F.get(padded, i * 2 + 1)),
    )


def _depth_steps(leaves: Column) -> Column:
    """One element per level above the leaves."""
    depth = F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int")
    return F.slice(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), F.lit(1), depth)


def merkle_root(leaves: Column) -> Column:
    """Hex root of a non-empty leaf array; null for an empty one."""
    top = F.aggregate(
        _depth_steps(leaves),
        F.transform(leaves, lambda h: F.unhex(h)),
        lambda level, _: _parents(_pad(level)),
    )
    return F.when(F.size(leaves) > 0, F.lower(F.hex(F.get(top, F.lit(0)))))


def merkle_levels(leaves: Column) -> Column:
    """Padded levels from the leaves up to, and without, the root."""
    first = F.array(F.transform(leaves, lambda h: F.unhex(h)))
    grown = F.aggregate(
        _depth_steps(leaves),
        first,
        lambda levels, _: F.concat(
            F.slice(levels, F.lit(1), F.size(levels) - 1),
            F.array(_pad(F.element_at(levels, -1)), _parents(_pad(F.element_at(levels, -1)))),
        ),
    )
    return F.slice(grown, F.lit(1), F.size(grown) - 1)


def merkle_proof(levels: Column, index: Column) -> Column:
    """Array of (sibling hex, direction) from leaf to root; L or R says where the sibling sits."""

    def step(level: Column, depth: Column) -> Column:
        position = F.floor(index / F.pow(F.lit(2.0), depth)).cast("int")
        is_left = position % 2 == 0
        sibling = F.when(is_left, position + 1).otherwise(position - 1)
        return F.struct(
            F.lower(F.hex(F.get(level, sibling))).alias("sibling"),
            F.when(is_left, F.lit("R")).otherwise(F.lit("L")).alias("direction"),
        )

    return F.transform(levels, step)


def merkle_verify(leaf: Column, proof: Column, root: Column) -> Column:
    running = F.aggregate(
        proof,
        F.unhex(leaf),
        lambda acc, s: F.when(
            s["direction"] == "R", _hash_pair(acc, F.unhex(s["sibling"]))
        ).otherwise(_hash_pair(F.unhex(s["sibling"]), acc)),
    )
    return F.coalesce(F.lower(F.hex(running)) == F.lower(root), F.lit(False))
