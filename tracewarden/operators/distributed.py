"""Order-dependent primitives that never put a whole group into one task.

A global ``Window.orderBy`` sends everything to one task, and ``partitionBy(class)`` does the same
for a class that holds most of the rows. The helpers here split the ordered domain into buckets,
sum per bucket (small, map-side combined), and run the window only inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HASH_BUCKET_CHARS = 5  # about a million buckets


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other, keeping the left copy of the key columns.

    The keys travel as one struct, which is never null itself, so this stays an ordinary hash or
    sort-merge join.
    """
    keyed = right.withColumn("_k", F.struct(*keys)).drop(*keys)
    return left.withColumn("_k", F.struct(*keys)).join(keyed, "_k", how).drop("_k")


def null_safe_full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on one key in which nulls match; the key is taken from either side."""
    joined = left.withColumn("_k", F.struct(key)).drop(key).join(right.withColumn("_k", F.struct(key)).drop(key), "_k", "full_outer")
    return joined.withColumn(key, F.col("_k")[key]).drop("_k")


def pin(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep later filters above this point: all of them, or those on ``columns``.

    Catalyst moves a filter below the projections that compute its columns and repeats their
    expressions there. For digests over digests that repeats the whole chain at every level. A
    generator over a one-element array cannot be crossed, and costs a row copy. Columns beside it are
    filtered further down, and are left out where nothing reads them.
    """
    held = columns or df.columns
    others = [c for c in df.columns if c not in held]
    return df.select(F.inline(F.array(F.struct(*held))), *others).select(*df.columns)


def running_totals(
    df: DataFrame, order: str, measures: list[str], by: list[str] | None = None, bucket: Column | None = None,
) -> DataFrame:
    """Exclusive prefix sums of ``measures`` along ``order`` inside each ``by`` group.

    ``df`` holds one row per (by, order). Adds ``<m>_before`` and ``<m>_total``. Without an
    order-preserving ``bucket`` expression, buckets are the ranges of one range shuffle by (by, order),
    as many as there are shuffle partitions; a group of any size lies in as many of them as it fills.
    Range borders come from a sample, so the dealt rows are checkpointed: every branch, and every retry,
    sees the same buckets. Sums per bucket are the only rows that are ever ordered across buckets.
    """
    by = by or []
    keyed = ranged(df, [*by, order]) if bucket is None else df.withColumn("_bucket", bucket)
    group = F.struct(*by, "_bucket").alias("_k")
    per_bucket = keyed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    whole = W.partitionBy(*by)
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures]
    # group totals ride along, so the rows are never joined (or shuffled) by group alone
    offsets += [F.sum(f"_sum_{m}").over(whole).alias(f"{m}_total") for m in measures]
    offsets = per_bucket.select(group, *offsets)
    # join and window share the key, so the rows move once
    joined = keyed.withColumn("_k", group).join(offsets, "_k")
    inside = W.partitionBy("_k").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumns({
        f"{m}_before": F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures
    }).drop("_k", "_bucket", *[f"_off_{m}" for m in measures])


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in ranges of ``keys``, with the range's number as ``_bucket``, settled by a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).withColumn("_bucket", F.spark_partition_id()).checkpoint()


def row_positions(df: DataFrame, order: str, by: list[str] | None = None, out: str = "position") -> DataFrame:
    """Contiguous zero-based rank of a unique ``order`` column (per group), plus group size.

    Works on ids of any kind, however sparse: the ranges follow the rows and not the values.
    """
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by)
    return (
        ranked.withColumnRenamed("_one_before", out)
        .withColumnRenamed("_one_total", out + "_total")
        .drop("_one")
    )


def value_at_positions(
    df: DataFrame, key: str, bucket: Column, positions: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """Key found at given zero-based ranks, without ranking the table.

    ``positions`` has (by..., _target) with few rows. A histogram over ``bucket`` (order-preserving)
    locates the bucket of each target, and only those buckets are ranked. Keys are unique per group.
    """
    by = by or []
    slim = df.select(*by, key).withColumn("_bucket", bucket)
    histogram = slim.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cumulative = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    matched = null_safe_join(cumulative, positions, by) if by else cumulative.withColumn(
        "_target", F.explode(positions.agg(F.collect_list("_target")).scalar())
    )
    edges = matched.where(
        (F.col("_target") >= F.col("_before")) & (F.col("_target") < F.col("_before") + F.col("_n"))
    )
    edge_buckets = edges.select(*by, "_bucket", "_before").distinct()
    candidates = null_safe_join(slim, edge_buckets, [*by, "_bucket"])
    inside = W.partitionBy(*by, "_bucket").orderBy(key)
    ranked = candidates.withColumn("_target", F.col("_before") + F.row_number().over(inside) - 1)
    return null_safe_join(
        ranked.select(*by, "_target", key), positions, [*by, "_target"]
    )


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, feature, value, n) for numeric columns, one scan for all of them; nulls and NaN left out."""
    by = by or []
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, columns, "feature", "value"
    )
    return (
        long.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))
    )


def exact_percentiles(
    df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation: (by, feature, p0, p1, ...).

    The built-in ``percentile`` holds every distinct value of a group in one buffer; this one ranks
    the distinct values in buckets and then picks two of them per probability.
    """
    by = by or []
    return percentiles_of(running_totals(value_counts(df, columns, by), "value", ["n"], [*by, "feature"]), probabilities, by)


def percentiles_of(ranked: DataFrame, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """The same from a frame of (by, feature, value, n) with its running totals."""
    by = by or []
    upto = F.col("n_before") + F.col("n")
    aggregates = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("n_total") - 1).cast("double")
        for name, target in ((f"_lo{i}", F.floor(rank)), (f"_hi{i}", F.ceil(rank))):
            hit = (target >= F.col("n_before")) & (target < upto)
            aggregates.append(F.max(F.when(hit, F.col("value"))).alias(name))
    picked = ranked.groupBy(*by, "feature").agg(F.max("n_total").alias("_n"), *aggregates)
    out = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        fraction = rank - F.floor(rank)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction).alias(f"p{i}"))
    return picked.select(*by, "feature", *out)


def quantile_grids(ranked: DataFrame, grids: list[tuple[list[float], Column]]) -> DataFrame:
    """(grid, i, quantile) for long lists of evenly spaced probabilities of one column.

    ``ranked`` is the output of ``running_totals`` over ``value`` and ``n``. Each grid comes with a
    condition on the ranked row that says whether it is wanted. Every value works out by arithmetic
    which few probabilities can fall on it, so the cost does not grow with their number.
    """
    hits = [F.when(wanted, _grid_hits(g, probabilities)) for g, (probabilities, wanted) in enumerate(grids)]
    rows = ranked.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select(F.inline("h"))
    found = rows.groupBy("grid", "i").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("fraction").alias("fraction")
    )
    return found.select("grid", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("fraction")).alias("quantile"))


def _grid_hits(grid: int, probabilities: list[float]) -> Column:
    """Array of the probabilities whose lower or upper neighbour is this row's value."""
    count = len(probabilities)
    start, step = probabilities[0], (probabilities[-1] - probabilities[0]) / (count - 1)
    table = F.array(*[F.lit(float(p)) for p in probabilities])
    last = (F.col("n_total") - 1).cast("double")
    before, after = F.col("n_before").cast("double"), (F.col("n_before") + F.col("n")).cast("double")

    def index(position: Column) -> Column:
        return F.floor((position / F.greatest(last, F.lit(1.0)) - start) / step)

    # one position of slack on either side; the exact test below decides
    low = F.greatest(F.lit(0), index(before - 1.0) - 1)
    high = F.least(F.lit(count - 1), index(after) + 1)
    span = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
    rank = lambda i: F.get(table, i) * last
    inside = lambda x: (x >= before) & (x < after)
    return F.transform(
        F.filter(span, lambda i: inside(F.floor(rank(i))) | inside(F.ceil(rank(i)))),
        lambda i: F.struct(
            F.lit(grid).alias("grid"), i.alias("i"),
            F.when(inside(F.floor(rank(i))), F.col("value")).alias("lo"),
            F.when(inside(F.ceil(rank(i))), F.col("value")).alias("hi"),
            (rank(i) - F.floor(rank(i))).alias("fraction"),
        ),
    )
