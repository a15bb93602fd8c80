"""Feature screening and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEAKAGE_F1_CUTOFF
from .distributed import running_totals
from .metrics import ratio


def _counts(df: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """(feature, value, c0, c1, ...): class counts per distinct value, one scan for all features."""
    long = df.select(F.col(label).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["_y"], features, "feature", "value"
    )
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        *[F.count_if(F.col("_y") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    )


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def fit_stumps(train: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """Best depth-1 Gini split of every feature: (feature, threshold, left_class, right_class).

    Cumulative class counts over the sorted distinct values give every candidate split at once. The
    threshold is the midpoint to the next value; an unsplittable feature has a null threshold.
    """
    k = range(len(classes))
    measures = [f"c{i}" for i in k]
    counts = _counts(train, features, label, classes)
    ranked = running_totals(counts, "value", measures, ["feature"])
    d = lambda c: c.cast("double")
    left = [d(F.col(f"c{i}_before") + F.col(f"c{i}")) for i in k]
    right = [d(F.col(f"c{i}_total")) - left[i] for i in k]
    n_left, n_right = _total(left), _total(right)
    purity = _total([x * x for x in left]) / n_left + _total([x * x for x in right]) / F.nullif(n_right, F.lit(0.0))

    def best_class(values: list[Column]) -> Column:
        array = F.array(*values)
        return F.array_position(array, F.array_max(array)) - 1

    scored = ranked.select(
        "feature", "value", F.coalesce(purity, F.lit(-1.0)).alias("purity"),
        best_class(left).alias("left_index"), best_class(right).alias("right_index"),
    )
    # highest purity; the smallest value on a tie
    best = scored.groupBy("feature").agg(
        F.max(F.struct("purity", (-F.col("value")).alias("neg"), "left_index", "right_index")).alias("b")
    ).select("feature", F.col("b.purity").alias("purity"), (-F.col("b.neg")).alias("value"), "b.left_index", "b.right_index")
    following = counts.select("feature", F.col("value").alias("v")).join(best, "feature").where(
        F.col("v") > F.col("value")
    ).groupBy("feature").agg(F.min("v").alias("next_value"))
    names = F.array(*[F.lit(c) for c in classes])
    return best.join(following, "feature", "left").select(
        "feature", ((F.col("value") + F.col("next_value")) / 2.0).alias("threshold"),
        F.get(names, F.col("left_index")).alias("left_class"),
        F.get(names, F.when(F.col("next_value").isNull(), F.col("left_index")).otherwise(F.col("right_index"))).alias("right_class"),
    )


def stump_screen(
    train: DataFrame, val: DataFrame, features: list[str], label: str, classes: list[str],
    cutoff: float = LEAKAGE_F1_CUTOFF,
) -> DataFrame:
    """(feature, solo_macro_f1, flagged): how well each feature alone predicts the class on ``val``.

    Macro-F1 runs over classes that occur as truth or prediction. A high score hints at leakage.
    """
    stumps = fit_stumps(train, features, label, classes)
    counts = _counts(val, features, label, classes)
    k = range(len(classes))
    sides = counts.join(stumps, "feature").withColumn(
        "pred", F.when(F.col("threshold").isNull() | (F.col("value") <= F.col("threshold")), F.col("left_class"))
        .otherwise(F.col("right_class"))
    ).groupBy("feature").agg(
        *[F.sum(f"c{i}").alias(f"s{i}") for i in k],
        *[F.sum(F.when(F.col("pred") == classes[i], F.col(f"c{i}")).otherwise(0)).alias(f"t{i}") for i in k],
        *[F.sum(F.when(F.col("pred") == classes[i], _total([F.col(f"c{j}") for j in k])).otherwise(0)).alias(f"p{i}") for i in k],
    )
    f1 = [ratio(2 * F.col(f"t{i}"), F.col(f"s{i}") + F.col(f"p{i}")) for i in k]
    used = [((F.col(f"s{i}") + F.col(f"p{i}")) > 0).cast("double") for i in k]
    macro = _total([f1[i] * used[i] for i in k]) / _total(used)
    return sides.select("feature", macro.alias("solo_macro_f1")).withColumn("flagged", F.col("solo_macro_f1") > cutoff)


def feature_rank(scores: DataFrame, score: str, n: int) -> DataFrame:
    """Top ``n`` by score; ties by name, so the result is stable."""
    return scores.orderBy(F.col(score).desc(), "feature").limit(n)
