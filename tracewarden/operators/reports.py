"""Size, latency, throughput, loss and capacity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .distributed import null_safe_full_join, null_safe_join, percentiles_of, row_positions, running_totals, value_counts
from .metrics import ratio


def storage_overhead(df: DataFrame, record: Column, payload: Column) -> DataFrame:
    """Mean and maximum bytes of the committed record and the payload text, and the saving."""
    sizes = df.select(F.octet_length(record).alias("r"), F.octet_length(payload).alias("p"))
    return sizes.agg(
        F.count("*").alias("n"), F.avg("r").alias("record_bytes_mean"), F.max("r").cast("long").alias("record_bytes_max"),
        F.avg("p").alias("payload_bytes_mean"), F.max("p").cast("long").alias("payload_bytes_max"),
    ).withColumn("reduction_pct", 100.0 * (1.0 - F.col("record_bytes_mean") / F.col("payload_bytes_mean")))


def write_reduction(sizes: DataFrame, anchoring_rate: Column, batch: int = K.BATCH_SIZE) -> DataFrame:
    share = F.col("record_bytes_mean") / F.col("payload_bytes_mean")
    return sizes.select(
        (100.0 * (1.0 - 1.0 / F.lit(float(batch)))).alias("transaction_reduction_pct"),
        (100.0 * (1.0 - share)).alias("record_reduction_pct"),
        anchoring_rate.alias("anchoring_rate"),
        (100.0 * (1.0 - anchoring_rate * share)).alias("combined_reduction_pct"),
    )


def latency_percentiles(df: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 and max with linear interpolation, and p99 by nearest rank."""
    by = by or []
    ranked = running_totals(value_counts(df, [latency], by), "value", ["n"], [*by, "feature"])
    linear = percentiles_of(ranked, [0.5, 0.95, 0.99, 1.0], by)
    # rank = ceil(0.99 n), in integers
    rank = F.floor((F.col("n_total") * 99 + 99) / 100) - 1
    hit = (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))
    nearest = ranked.where(hit).select(*by, F.col("value").alias("p99_nearest"), F.col("n_total").alias("n"))
    linear = linear.select(*by, F.col("p0").alias("p50"), F.col("p1").alias("p95"), F.col("p2").alias("p99"), F.col("p3").alias("max"))
    return linear.join(nearest, by) if by else linear.withColumn(
        "_x", nearest.select(F.struct("p99_nearest", "n")).scalar()
    ).select("p50", "p95", "p99", "max", "_x.p99_nearest", "_x.n")


def throughput(df: DataFrame, started: Column, finished: Column, by: list[str] | None = None) -> DataFrame:
    """Rows per second between the first start and the last finish (both in seconds)."""
    elapsed = F.max(finished) - F.min(started)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), elapsed.alias("elapsed_sec"),
        (F.count("*") / F.nullif(elapsed, F.lit(0.0))).alias("per_second"),
    )


def batch_factor(rate_per_sec: Column, target: float = K.TARGET_TPS) -> Column:
    """Smallest batch factor that keeps the commit rate within the target."""
    return F.when(rate_per_sec <= target, F.lit(1)).otherwise(F.ceil(rate_per_sec / target)).cast("long")


def capacity_table(anchor_rate: DataFrame, target: float = K.TARGET_TPS) -> DataFrame:
    """Arrival rates x batch factors for a one-row frame with ``anchor_rate``."""
    arrivals = F.explode(F.array(*[F.lit(a).cast("long") for a in K.ARRIVAL_RATES])).alias("arrival_per_sec")
    factors = F.explode(F.array(*[F.lit(b).cast("long") for b in K.BATCH_FACTORS])).alias("batch_factor")
    grid = anchor_rate.select("anchor_rate", arrivals).select("anchor_rate", "arrival_per_sec", factors)
    anchors = F.col("arrival_per_sec") * F.col("anchor_rate")
    return grid.select(
        "arrival_per_sec", F.round("anchor_rate", 6).alias("anchor_rate"), F.round(anchors, 2).alias("anchors_per_sec"),
        "batch_factor", F.round(anchors / F.col("batch_factor"), 3).alias("required_per_sec"),
        (anchors / F.col("batch_factor") <= target).alias("within_target"),
    )


def loss_accounting(
    submitted: DataFrame, outcomes: DataFrame, key: str = "event_id", rejected: DataFrame | None = None,
) -> DataFrame:
    """Submissions against outcomes and rejections, matched by id and not only by totals.

    An id may be submitted several times, but it is settled once: every further submission needs a row
    in ``rejected``. Without one it is lost, so ``zero_loss`` cannot hold.
    """
    if rejected is None:
        rejected = outcomes.limit(0)
    per_id = outcomes.groupBy(key).agg(
        F.count_if(F.col("outcome") == "committed").alias("c"),
        F.count_if(F.col("outcome") == "dead_lettered").alias("d"),
        F.max(F.when(F.col("outcome") == "committed", F.col("attempts"))).alias("attempts"),
    )
    sent = submitted.groupBy(key).agg(F.count("*").alias("s"))
    refused = rejected.groupBy(key).agg(F.count("*").alias("r"))
    joined = null_safe_full_join(null_safe_full_join(sent, per_id, key), refused, key)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    done, total = n("c") + n("d"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.agg(
        total(n("s")).alias("submitted"), F.count_if(n("c") > 0).alias("committed"),
        F.count_if(n("d") > 0).alias("dead_lettered"), total(n("r")).alias("rejected"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        total(F.greatest(n("s") - n("r") - F.least(done, F.lit(1)), F.lit(0))).alias("lost"),
        F.count_if(done > 1).alias("counted_twice"), F.count_if(n("s") == 0).alias("unknown"),
    ).withColumn("zero_loss", (F.col("lost") == 0) & (F.col("counted_twice") == 0) & (F.col("unknown") == 0))


def longest_run(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """Longest run of consecutive rows for which ``hit`` holds, as a one-row frame.

    Gaps and islands with two distributed ranks: within a run, the difference between the rank among
    all rows and the rank among hits is constant.
    """
    placed = row_positions(df.select(order, hit.alias("_hit")), order, out="_all")
    hits = row_positions(placed.where("_hit").select(order, "_all"), order, out="_among")
    runs = hits.groupBy((F.col("_all") - F.col("_among")).alias("island")).agg(F.count("*").alias("length"))
    return runs.agg(F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest_run"))


def anchor_summary(df: DataFrame, label: str, anchor: str, confidence: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("processed"), F.count_if(anchor).alias("anchored"), F.count_if(~F.col(anchor)).alias("off_chain"),
        F.avg(F.col(anchor).cast("double")).alias("anchored_share"), F.avg(confidence).alias("mean_confidence"),
    )


def key_results(row: DataFrame, names: list[str]) -> DataFrame:
    """Metric-value rows from a one-row frame."""
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "metric", "value")


STREAM_DIGEST_ROWS = 1_000_000


def stream_digest(df: DataFrame, order: str, digest: str, by: list[str]) -> DataFrame:
    """SHA-256 over the concatenated digests of a bounded ordered group (a batch, a run).

    A digest of a sequence needs the whole sequence, so a group of more than ``STREAM_DIGEST_ROWS`` rows
    is refused instead of collected; digest it by batches and those by their digests.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda s: s[digest])
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    fine = F.when(F.col("_n") <= STREAM_DIGEST_ROWS, F.lit(True)).otherwise(F.raise_error(F.lit("a group is too long for one digest")))
    checked = null_safe_join(df.select(*by, order, digest), counts, by).where(fine)
    return checked.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(ordered, ""), 256).alias("stream_digest"))


def arrival_windows(
    arrivals: DataFrame, arrived: str, commits: DataFrame, committed: str, interval: str = "1 hour"
) -> DataFrame:
    """Arrivals and commits per tumbling window, with the backlog at its end."""
    a = arrivals.groupBy(F.window(arrived, interval).alias("w")).agg(F.count("*").alias("arrivals"))
    c = commits.groupBy(F.window(committed, interval).alias("w")).agg(F.count("*").alias("commits"))
    both = (
        a.join(c, "w", "full_outer")
        .select(F.col("w.start").alias("window_start"), F.coalesce("arrivals", F.lit(0)).alias("arrivals"),
                F.coalesce("commits", F.lit(0)).alias("commits"))
    )
    ranked = running_totals(both, "window_start", ["arrivals", "commits"], bucket=F.year("window_start"))
    return ranked.select(
        "window_start", "arrivals", "commits",
        (F.col("arrivals_before") + F.col("arrivals") - F.col("commits_before") - F.col("commits")).alias("backlog"),
    )


PUBLISHED = [
    # system, accuracy, f1, f1_kind, classification, same dataset
    ("Nguyen et al.", 0.995, 0.995, "weighted", "binary", True),
    ("Nguyen et al.", None, 0.992, "weighted", "multiclass", True),
    ("Sarhan et al.", 0.891, 0.889, "weighted", "binary", True),
]


def benchmark_table(own: DataFrame) -> DataFrame:
    """Own rows stacked over published ones; a null metric reads "not reported".

    ``own`` has (system, accuracy, f1, f1_kind, classification, matched_dataset).
    """
    published = own.sparkSession.createDataFrame(
        PUBLISHED, "system string, accuracy double, f1 double, f1_kind string, classification string, matched_dataset boolean"
    )
    both = own.withColumn("origin", F.lit("measured")).unionByName(published.withColumn("origin", F.lit("published")))
    text = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("not reported"))
    return both.withColumns({
        "accuracy": F.when(F.col("accuracy").isNull(), "not reported").otherwise(text("accuracy")),
        "f1": F.when(F.col("f1").isNull(), "not reported").otherwise(text("f1")),
    })


def metric_lookup(table: DataFrame, key: str, target: float, tolerance: float = 1e-9) -> DataFrame:
    """Rows of a metric table whose key equals a target within a tolerance."""
    return table.where(F.abs(F.col(key) - F.lit(float(target))) < tolerance)


def reported_calibration_error(table: DataFrame, method: str = "method", preferred: str = "isotonic") -> DataFrame:
    """The preferred method's ECE, or the lowest one when it is absent."""
    own = F.min(F.when(F.lower(method).contains(preferred), F.col("ece")))
    return table.agg(F.coalesce(own, F.min("ece")).alias("expected_calibration_error"))
