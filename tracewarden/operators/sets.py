"""Set comparisons of labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(value, side) of values present on one side only."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return (
        a.subtract(b).withColumn("side", F.lit("left_only")).union(b.subtract(a).withColumn("side", F.lit("right_only")))
        .withColumnRenamed(column, "value")
    )


def missing_classes(df: DataFrame, split: str, label: str) -> DataFrame:
    """(split, class) pairs absent from the data although both occur in it.

    Works on the distinct pairs (splits x classes), not on rows.
    """
    pairs = df.select(split, label).distinct()
    every = pairs.agg(F.collect_set(label).alias("all")).scalar()
    per_split = pairs.groupBy(split).agg(F.collect_set(label).alias("seen")).withColumn("all", every)
    return per_split.select(split, F.explode(F.array_except("all", "seen")).alias("class"))


def allowed_only(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(*allowed))
