"""Rank-based metrics (ROC, average precision) from one table of counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributed import running_totals


def score_counts(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg): rows collapse map-side to one per distinct score."""
    return df.select(*(by or []), score.alias("score"), positive.alias("_p")).groupBy(*(by or []), "score").agg(
        F.count_if("_p").alias("pos"), F.count_if(~F.col("_p")).alias("neg")
    )


def one_vs_rest_counts(df: DataFrame, truth: str, prob: Column, labels: list[str]) -> DataFrame:
    """Counts for every class against the rest, from one scan."""
    names = F.array(*[F.lit(c) for c in labels])
    pairs = F.arrays_zip(names.alias("class"), prob.alias("score"))
    long = df.select(F.col(truth).alias("_t"), F.inline(pairs).alias("class", "score"))
    return score_counts(long, F.col("score"), F.col("_t") == F.col("class"), ["class"])


def _ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    return running_totals(counts, "score", ["pos", "neg"], by)


def roc_auc(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs ranked correctly, ties counting half; null for one class."""
    d = lambda c: F.col(c).cast("double")
    wins = F.sum(d("pos") * (d("neg_before") + d("neg") / 2.0))
    pairs = F.max(d("pos_total")) * F.max(d("neg_total"))
    return _ranked(counts, by or []).groupBy(*(by or [])).agg(
        (wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"), F.max("pos_total").alias("support")
    )


def average_precision(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores, best first, of the recall step times the precision there."""
    d = lambda c: F.col(c).cast("double")
    tp, fp = d("pos_total") - d("pos_before"), d("neg_total") - d("neg_before")
    step = d("pos") / F.nullif(d("pos_total"), F.lit(0.0))
    return _ranked(counts, by or []).groupBy(*(by or [])).agg(F.sum(step * tp / (tp + fp)).alias("average_precision"))


def roc_curve(counts: DataFrame) -> DataFrame:
    """(point, threshold, fpr, tpr), best score first: one point per distinct score.

    The origin, whose threshold is null, is point 0. ``thinned`` makes a long curve short.
    """
    marked = counts.withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(marked, "score", ["pos", "neg", "one"])
    d = lambda c: F.col(c).cast("double")
    points = ranked.select(
        (F.col("one_total") - F.col("one_before")).alias("point"),
        F.col("score").alias("threshold"),
        ((d("neg_total") - d("neg_before")) / F.nullif(d("neg_total"), F.lit(0.0))).alias("fpr"),
        ((d("pos_total") - d("pos_before")) / F.nullif(d("pos_total"), F.lit(0.0))).alias("tpr"),
    )
    origin = counts.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def thinned(curve: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th point of a curve and both of its ends."""
    last = curve.agg(F.max("point")).scalar()
    return curve.where((F.col("point") % step == 0) | (F.col("point") == last))
