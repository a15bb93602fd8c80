"""Capture order: keep-first deduplication, row positions and positional splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SPLIT_FRACTIONS
from .distributed import row_positions


def keep_first(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """One row per distinct content, with the smallest ``order``.

    A grouped minimum instead of a window: copies collapse map-side, so one row repeated a billion
    times costs one record per task, and the surviving row is the group itself (no join back).
    """
    content = columns or [c for c in df.columns if c != order]
    return df.groupBy(*content).agg(F.min(order).alias(order)).select(*df.select(order, *content).columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def positional_split(
    df: DataFrame, order: str, fractions: tuple[float, float, float] = SPLIT_FRACTIONS,
    out: str = "split",
) -> DataFrame:
    """train / val / test by capture position; sizes floor, the remainder goes to test.

    Only two border ids are looked up, by ranking the id column alone, and then every row is classified
    by comparison: the rows themselves are not shuffled.
    """
    n = F.col("n")
    train, val = (F.floor(n * f).cast("long") for f in fractions[:2])
    ends = df.agg(F.count("*").alias("n")).select(train.alias("first_val"), (train + val).alias("first_test"))
    targets = ends.select(F.explode(F.array_distinct(F.array("first_val", "first_test"))).alias("_target"))
    found = row_positions(df.select(order), order, out="_target").join(F.broadcast(targets), "_target")  # two targets
    ids = found.agg(F.map_from_entries(F.collect_list(F.struct("_target", order))).alias("m")).scalar()  # at most two
    marked = df.withColumn("_ids", ids).withColumn("_ends", ends.select(F.struct("*").alias("e")).scalar())
    # a rank past the last row finds no id: then nothing lies beyond that border
    first_val, first_test = (F.try_element_at("_ids", F.col("_ends")[c]) for c in ("first_val", "first_test"))
    split = (
        F.when(first_val.isNull() | (F.col(order) < first_val), "train")
        .when(first_test.isNull() | (F.col(order) < first_test), "val").otherwise("test")
    )
    return marked.withColumn(out, split).drop("_ids", "_ends")


def row_position(df: DataFrame, order: str) -> DataFrame:
    return row_positions(df, order).drop("position_total")


def tail_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def head_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)
