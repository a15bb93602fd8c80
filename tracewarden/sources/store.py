"""Content-addressed payload store as an append-only table.

Columns: (content_address, payload, size_bytes). The address is the SHA-256 of the payload text, so
equal payloads share a row and a put never changes one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import content_address, parse_address
from ..operators.distributed import pin

COLUMNS = ["content_address", "payload", "size_bytes"]


def as_stored(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    text = F.col(payload)
    return payloads.select(
        content_address(text).alias("content_address"), text.alias("payload"), F.octet_length(text).cast("long").alias("size_bytes")
    )


def shard_of(address: Column) -> Column:
    """The partition of an address: ``s`` and its first two hex digits."""
    return F.concat(F.lit("s"), F.substring(parse_address(address), 1, 2))


def opened(store: DataFrame, requests: DataFrame, address: str = "content_address") -> DataFrame:
    """The partitions of the store that the requests can hit; a store that was never written is taken whole."""
    if "shard" not in store.columns:
        return store
    wanted = [r[0] for r in requests.select(shard_of(F.col(address))).distinct().collect() if r[0]]  # at most 256
    return store.where(F.col("shard").isin(*wanted)) if wanted else store.limit(0)


def new_payloads(payloads: DataFrame, store: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows a put would add: distinct addresses the store does not hold yet.

    Copies collapse map-side before the shuffle. Only the store's address column is read.
    """
    rows = as_stored(payloads, payload).groupBy("content_address").agg(
        F.first("payload").alias("payload"), F.first("size_bytes").alias("size_bytes")
    )
    # pinned: an anti join is pushed below projections, which would repeat the digest expressions; the payload is moved only where it is read
    return pin(rows, ["content_address"]).join(opened(store, rows).select("content_address"), "content_address", "left_anti")


def put(spark: SparkSession, payloads: DataFrame, path: str, payload: str = "payload") -> None:
    """Append what is missing. The first two hex digits are the partition, so lookups can prune."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException as exc:  # a store that is not there yet
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = as_stored(payloads, payload).dropDuplicates(["content_address"])
    else:
        rows = new_payloads(payloads, held, payload)
    rows.withColumn("shard", shard_of(F.col("content_address"))).write.mode("append").partitionBy("shard").parquet(path)


def get(requests: DataFrame, store: DataFrame, address: str = "content_address") -> DataFrame:
    """Requests with their payload; a missing one has a null payload (the caller decides)."""
    keyed = requests.withColumn("_k", parse_address(F.col(address)))
    held = opened(store, requests, address).select(parse_address(F.col("content_address")).alias("_k"), "payload", "size_bytes")
    return keyed.join(held, "_k", "left").drop("_k")


def exists(requests: DataFrame, store: DataFrame, address: str = "content_address") -> DataFrame:
    """Requests with ``exists``; malformed addresses are false."""
    held = opened(store, requests, address).select(parse_address(F.col("content_address")).alias("_k"), F.lit(True).alias("_held")).distinct()
    return requests.withColumn("_k", parse_address(F.col(address))).join(held, "_k", "left").withColumn(
        "exists", F.coalesce("_held", F.lit(False))
    ).drop("_k", "_held")
