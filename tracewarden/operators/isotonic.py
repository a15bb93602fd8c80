"""Isotonic regression of any number of scores, as a table of blocks.

The isotonic fit is the slope of the greatest convex minorant of the points (weight so far, positives so far) in order
of score. Prefix sums give every distinct score its point without ordering the table in one task, and a minorant of a union
of points is the minorant of the minorants' corners, so ranges of scores are reduced apart and merged level by level.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .distributed import running_totals

#: Ranges that one task of a merging round takes together.
FAN_IN = 16
_CORNERS = "part long, weight long, positive long"


def _corners(group: pa.Table) -> pa.Table:
    """The corners of the lower convex hull of a group's points, in exact integers."""
    part = group.column("part")[0].as_py()
    points = sorted(zip(group.column("weight").to_pylist(), group.column("positive").to_pylist()))
    hull: list[tuple[int, int]] = []
    for x, y in points:
        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (y - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]):
            hull.pop()
        if not hull or (x, y) != hull[-1]:
            hull.append((x, y))
    return pa.table([pa.array([part] * len(hull), pa.int64()), pa.array([h[0] for h in hull], pa.int64()), pa.array([h[1] for h in hull], pa.int64())],
                    ["part", "weight", "positive"])


def isotonic_blocks(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(block, low, high, n, positives, value): the blocks of the rising fit, scores from ``low`` to ``high`` each.

    ``value`` is the share of positives of a block; it rises from block to block. Rows without a score (null, NaN) or without
    a label are left out; scores that are equal share a block. What one task holds is a range of distinct scores, then the
    corners of ``FAN_IN`` ranges, at last those of the whole fit: as many as it has blocks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = F.col(score).cast("double")
    rows = df.select((x + 0.0).alias("s"), positive.cast("long").alias("y")).where("s is not null and not isnan(s) and y is not null")
    distinct = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    summed = running_totals(distinct, "s", ["n", "y"]).checkpoint()
    # the point before each score; that behind the last one closes the curve
    before = summed.select(F.col("n_before").alias("weight"), F.col("y_before").alias("positive"))
    last = summed.groupBy().agg(F.max("n_total").alias("weight"), F.max("y_total").alias("positive")).where("weight is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    points = before.unionByName(last)
    total = last.select("weight").first()
    if total is None:
        return spark.createDataFrame([], "block long, low double, high double, n long, positives long, value double")
    corners = points.withColumn("part", F.least(F.floor(F.col("weight") * parts / F.lit(total[0])), F.lit(parts - 1)).cast("long"))
    while True:
        corners = corners.groupBy("part").applyInArrow(_corners, _CORNERS)
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
        corners = corners.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
    # a score belongs to the block between two corners of the whole curve
    corners = corners.checkpoint()
    order = W.orderBy("weight")  # one row a block
    blocks = corners.select(
        (F.row_number().over(order) - 1).cast("long").alias("block"), F.col("weight").alias("start"), F.lead("weight").over(order).alias("end"),
        (F.lead("weight").over(order) - F.col("weight")).alias("n"), (F.lead("positive").over(order) - F.col("positive")).alias("positives")).where("end is not null")
    # the first and the last score of a block are those whose sums touch its corners
    low = summed.select(F.col("n_before").alias("start"), F.col("s").alias("low"))
    high = summed.select((F.col("n_before") + F.col("n")).alias("end"), F.col("s").alias("high"))
    told = blocks.join(low, "start").join(high, "end")
    return told.select("block", "low", "high", "n", "positives", (F.col("positives") / F.col("n")).alias("value"))
