"""Connected components of a link table by star contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

MAX_ROUNDS = 60


def components(links: DataFrame, left: str = "a", right: str = "b", name: str = "component_id") -> DataFrame:
    """(id, ``name``): the smallest id reachable from each id that has a link.

    Alternates the two star steps: every node hangs its larger neighbours on the smallest
    neighbour, then its smaller ones. Each step is a grouped minimum (combined before the shuffle)
    and an equi join, so a hub of a third of all links is a skewed join key and never a collected
    group. The links of every round are a written table. Ids that are null or linked only with
    themselves do not appear.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = written(edges.where("u > v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias(name)).withColumnRenamed("u", "id")
    return stars.unionByName(stars.select(F.col(name).alias("id"), name).distinct())
