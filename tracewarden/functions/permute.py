"""A keyed bijection on row positions, so that a permutation needs no sort of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps that may be taken to get back below n. Fewer than sqrt(n) of all places lie beyond it.
WALKS = 40


def grid(n: Column) -> tuple[Column, Column]:
    """Sides of the grid of places for n positions."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return wide, F.floor((n + wide - 1) / wide).cast("long")


def permuted_position(position: Column, n: Column, key: int | Column) -> Column:
    """Where a permutation of [0, n) puts a position; every ``key`` is a permutation of its own.

    A Feistel network on pairs (left, right) of a grid of about sqrt(n) by sqrt(n) places, which has at least n
    and fewer than n + sqrt(n) of them: every round adds to one half a hash of the other, which is undone by taking it away
    again, so the network is one to one on the grid. A place beyond n is put through it again until it lies below, which
    keeps it one to one on [0, n).
    """
    wide, high = grid(n)
    turns = F.array(*[F.lit(sign * i) for i in range(1, ROUNDS + 1) for sign in (1, -1)])

    def network(x: Column) -> Column:
        # a turn changes ``a`` by a hash of ``b`` and swaps them; the sizes travel along, so that they are worked out once
        halves = F.struct(
            F.floor(x / high).cast("long").alias("a"), F.pmod(x, high).alias("b"), wide.alias("of_a"), high.alias("of_b"))

        def turn(h: Column, i: Column) -> Column:
            moved = F.pmod(h["a"] + F.pmod(F.xxhash64(h["b"], F.lit(key), i), h["of_a"]), h["of_a"])
            return F.struct(h["b"].alias("a"), moved.alias("b"), h["of_b"].alias("of_a"), h["of_a"].alias("of_b"))

        return F.aggregate(turns, halves, turn, lambda h: h["a"] * h["of_b"] + h["b"])

    def below(x: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), x, lambda y, _: F.when(y >= n, network(y)).otherwise(y))
        return F.when(x < n, x).otherwise(again)

    # the array binds the first place, which is below n for nearly every row
    return F.aggregate(
        F.array(network(position.cast("long"))), F.lit(0).cast("long"), lambda _, first: below(first),
        lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a position did not come back below n")).cast("long")))


def with_permuted_position(df: DataFrame, position: str, n: str, key: Column, out: str) -> DataFrame:
    """Add ``permuted_position`` as ``out``, for many rows: every turn is a projection of plain columns, which Spark compiles.

    Only rows whose first place lies beyond n walk on by the expression. ``key`` is an int column.
    """
    wide, high = grid(F.col(n))
    size_a, size_b, key_of = "_wide", "_high", key.alias("_key")
    now = df.select("*", wide.alias("_wide"), high.alias("_high"), key_of).select(
        "*", F.floor(F.col(position) / F.col("_high")).cast("long").alias("_a"), F.pmod(F.col(position), F.col("_high")).alias("_b"))
    for i in (sign * i for i in range(1, ROUNDS + 1) for sign in (1, -1)):
        side = F.col(size_a)
        moved = F.pmod(F.col("_a") + F.pmod(F.xxhash64("_b", "_key", F.lit(i)), side), side)
        now, size_a, size_b = now.withColumns({"_a": F.col("_b"), "_b": moved}), size_b, size_a
    now = now.withColumn("_first", F.col("_a") * F.col("_high") + F.col("_b"))
    walked = permuted_position(F.col("_first"), F.col(n), F.col("_key"))
    placed = now.withColumn(out, F.when(F.col("_first") < F.col(n), F.col("_first")).otherwise(walked))
    return placed.drop("_wide", "_high", "_key", "_a", "_b", "_first")
