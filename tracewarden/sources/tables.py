"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan of one table; column pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


SPREAD_MIN_BYTES = 1 << 20
#: Bytes of a stored table whose rows are one task's share of heavy work.
SHARE_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores, or longer ones than heavy work should have.

    A file with a single row group is one task however large the cluster is, and work per row
    (digests, model scoring) then runs on one core. Tasks grow in number and not in length with the table.
    The rows move as they are stored, before anything is derived from them; tiny tables are not worth it.
    """
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_MIN_BYTES:
        return df
    shares = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE_BYTES))
    return df if plan.toRdd().getNumPartitions() >= shares else df.repartition(shares)



SHARE_ROWS = 500_000


def bounded_shares(df: DataFrame, rows: int = SHARE_ROWS) -> DataFrame:
    """Deal rows to as many tasks as keep each at about ``rows``, if the cluster's cores are too few for that."""
    per_share = df.groupBy(F.spark_partition_id().alias("_share")).agg(F.count("*").alias("_n"))
    found = per_share.agg(*share_sizes()).first()
    return dealt(df, found["_parts"], found["_rows"], found["_largest"], rows)


def share_sizes() -> list[Column]:
    """What ``dealt`` wants to know, from one row (_share, _n) per task."""
    return [
        F.coalesce(F.max("_share") + 1, F.lit(0)).alias("_parts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("_largest"),
    ]


def dealt(df: DataFrame, parts: int, total: int, largest: int, rows: int = SHARE_ROWS) -> DataFrame:
    """The same for a frame whose sizes are known. Tasks that are short already are put together, and no row moves."""
    shares = -(-total // rows)
    if shares <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(shares) if largest > rows else df.coalesce(-(-parts // (rows // largest)))
