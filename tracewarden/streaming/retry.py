"""Retry schedule of failed commits as data: no task ever sleeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BACKOFF_BASE_SEC, BACKOFF_MULTIPLIER, MAX_ATTEMPTS


def backoff(attempt: Column) -> Column:
    """Seconds to wait after the given attempt failed."""
    return F.lit(BACKOFF_BASE_SEC) * F.pow(F.lit(BACKOFF_MULTIPLIER), F.greatest(attempt - 1, F.lit(0)))


def with_state(failed: DataFrame, failed_at: str, now: float | Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Add ``next_try_sec`` and ``state``: due, waiting, or dead_letter once attempts are used up."""
    next_try = F.col(failed_at) + backoff(F.col("attempt"))
    limit = now if isinstance(now, Column) else F.lit(float(now))
    return failed.withColumn("next_try_sec", next_try).withColumn(
        "state",
        F.when(F.col("attempt") >= max_attempts, "dead_letter").when(F.col("next_try_sec") <= limit, "due").otherwise("waiting"),
    )
