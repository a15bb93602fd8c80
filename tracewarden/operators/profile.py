"""Column profiles, class distributions, feature statistics and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN_VALUES, CORRELATION_CUTOFF
from .distributed import exact_percentiles

MAX_AGGREGATES_PER_JOB = 600  # above this, generated code gets too large for one method


def class_distribution(df: DataFrame, label: str, benign: list[str] | None = None) -> DataFrame:
    """(label, n, benign_per_row): count per label and the benign count divided by it."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    benign_n = counts.where(F.col("label").isin(benign or BENIGN_VALUES)).agg(F.sum("n")).scalar()
    return counts.withColumn("benign_ratio", benign_n.cast("double") / F.col("n").cast("double"))


def _long(df: DataFrame, columns: list[str], metrics: dict[str, callable]) -> DataFrame:
    """One aggregation over all columns, then one output row per column."""
    per_job = max(1, MAX_AGGREGATES_PER_JOB // len(metrics))
    parts = []
    for start in range(0, len(columns), per_job):
        chunk = columns[start:start + per_job]
        wide = df.agg(*[fn(c).alias(f"{i}_{m}") for i, c in enumerate(chunk) for m, fn in metrics.items()])
        rows = F.array(*[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{m}").alias(m) for m in metrics])
            for i, c in enumerate(chunk)
        ])
        parts.append(wide.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total, missing (null or NaN), infinite, finite min and max, and whether the column is constant."""
    as_double = lambda c: F.col(c).cast("double")
    metrics = {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_missing": lambda c: F.count_if(F.col(c).isNull() | F.isnan(as_double(c))),
        "n_infinite": lambda c: F.count_if(F.coalesce(F.abs(as_double(c)) == float("inf"), F.lit(False))),
        "min_value": lambda c: F.min(_finite(c)),
        "max_value": lambda c: F.max(_finite(c)),
    }
    return _long(df, columns, metrics).withColumn(
        "zero_variance", F.coalesce(F.col("min_value") == F.col("max_value"), F.lit(False))
    )


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type, nulls, exact distinct values, min and max (as text) of each column.

    Distinct values are counted by grouping (column, value), which combines map-side and spreads a
    column over all tasks; several ``count(distinct)`` in one aggregate would expand every row.
    """
    types = dict(df.dtypes)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    distinct = (
        long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
        .groupBy("column_name").agg(
            F.count("value").alias("n_distinct"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        )
    )
    ends = _long(df, columns, {
        "min_value": lambda c: F.min(c).cast("string"), "max_value": lambda c: F.max(c).cast("string"),
    })
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return distinct.join(ends, "column_name").select(
        "column_name", dtype[F.col("column_name")].alias("dtype"), "n_null", "n_distinct", "min_value", "max_value"
    )


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Post-mask ranges per column, the input of type narrowing."""
    return column_profile(df, columns).select("column_name", "min_value", "max_value")


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total, distinct and surplus rows; exact, since whole rows are compared and not their hashes."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        (F.sum("n") - F.count("*")).cast("long").alias("n_duplicates"),
    )


def split_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, p05, p95, min, max) with exact, linearly interpolated percentiles."""
    marks = exact_percentiles(df, columns, [0.5, 0.05, 0.95, 0.0, 1.0])
    names = {"p0": "median", "p1": "p05", "p2": "p95", "p3": "min", "p4": "max"}
    return marks.withColumnsRenamed(names)


def class_medians(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return exact_percentiles(df, columns, [0.5], [label]).withColumnRenamed("p0", "median")


def variant_counts(df: DataFrame, label: str, fine: str) -> DataFrame:
    return df.groupBy(label, fine).agg(F.count("*").alias("n"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, correlation) for the upper triangle, all pairs from one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    parts = []
    for start in range(0, len(pairs), MAX_AGGREGATES_PER_JOB):
        chunk = pairs[start:start + MAX_AGGREGATES_PER_JOB]
        wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(chunk)])
        rows = F.array(*[
            F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"),
                     F.col(f"c{i}").alias("correlation"))
            for i, (a, b) in enumerate(chunk)
        ])
        parts.append(wide.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"variance": lambda c: F.var_samp(c)}).withColumnRenamed("column_name", "feature")


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Constant features: pass A of the selection."""
    return column_profile(df, columns).where("zero_variance").select(F.col("column_name").alias("feature"))


def correlation_drop(df: DataFrame, columns: list[str], cutoff: float = CORRELATION_CUTOFF) -> DataFrame:
    """Features lost to correlation: of each pair above the cutoff the lower-variance one, and on
    equal variance the later column. Every pair is judged, also when one side is already lost."""
    spread = F.map_from_entries(F.collect_list(F.struct("feature", "variance")))  # one entry per column
    by_feature = variances(df, columns).agg(spread.alias("m")).scalar()
    pairs = correlation_pairs(df, columns).where(F.abs("correlation") > cutoff).withColumn("_v", by_feature)
    left, right = F.col("_v")[F.col("left_feature")], F.col("_v")[F.col("right_feature")]
    loser = F.when(left < right, F.col("left_feature")).otherwise(F.col("right_feature"))
    return pairs.select(loser.alias("feature")).distinct()
