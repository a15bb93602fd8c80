"""Rounding of double results for comparison across engines (summation order differs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
