"""Calibration tables, coverage-versus-volume curves, gates and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import COVERAGE_TARGETS, RELIABILITY_BINS, UNIFORM_TAUS
from .distributed import quantile_grids, running_totals, value_counts
from .metrics import ratio



# --- calibration -------------------------------------------------------------------------------
def bin_edges(bins: int = RELIABILITY_BINS) -> list[float]:
    """Inner edges of equal-width bins, as multiples of the step."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def bin_index(score: Column, bins: int = RELIABILITY_BINS) -> Column:
    """Bin number against the literal edges: an edge value goes up, out-of-range values are clipped."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    return F.size(F.filter(edges, lambda e: e <= score))


def reliability(
    df: DataFrame, score: str, positive: Column, bins: int = RELIABILITY_BINS, by: list[str] | None = None
) -> DataFrame:
    """One row per bin, empty bins included (count 0, nulls)."""
    by = by or []
    filled = (
        df.select(*by, F.col(score).alias("_s"), positive.cast("double").alias("_y"))
        .withColumn("bin", bin_index(F.col("_s"), bins))
        .groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("_s").alias("c"), F.avg("_y").alias("f"))
    )
    # at most `bins` rows per group: spread them into an array and back, so empty bins appear
    entries = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "c", "f"))))
    packed = filled.groupBy(*by).agg(entries.alias("m"))
    rows = packed.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    cell = F.try_element_at(F.col("m"), F.col("bin"))
    edges = F.array(*[F.lit(e) for e in [0.0, *bin_edges(bins), 1.0]])
    return rows.select(
        *by, "bin", F.get(edges, F.col("bin")).alias("bin_lo"), F.get(edges, F.col("bin") + 1).alias("bin_hi"),
        F.coalesce(cell["n"], F.lit(0).cast("long")).alias("count"),
        cell["c"].alias("mean_confidence"), cell["f"].alias("observed_frequency"),
        F.abs(cell["c"] - cell["f"]).alias("gap"),
    )


def calibration_error(
    df: DataFrame, score: str, positive: Column, bins: int = RELIABILITY_BINS, by: list[str] | None = None
) -> DataFrame:
    """ECE, MCE and Brier score."""
    by = by or []
    table = (
        df.select(*by, F.col(score).alias("_s"), positive.cast("double").alias("_y"))
        .withColumn("bin", bin_index(F.col("_s"), bins))
        .groupBy(*by, "bin").agg(
            F.count("*").alias("n"), F.avg("_s").alias("c"), F.avg("_y").alias("f"),
            F.sum((F.col("_s") - F.col("_y")) * (F.col("_s") - F.col("_y"))).alias("sq"),
        )
    )
    gap = F.abs(F.col("c") - F.col("f"))
    return table.groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
    )


def calibration_rank(errors: DataFrame, aucs: DataFrame, method: str = "method") -> DataFrame:
    """Methods with their rank by ECE and whether ranking quality stayed the same (AUC spread)."""
    joined = errors.join(aucs, method)
    spread = joined.agg(F.max("roc_auc") - F.min("roc_auc")).scalar()
    # one row per calibration method
    order = W.orderBy("ece", method)
    return joined.withColumn("auc_spread", spread).select(
        method, "ece", "mce", "brier", "roc_auc", F.row_number().over(order).cast("long").alias("rank"),
        (F.col("auc_spread") < 1e-4).alias("rank_preserving"),
    )


# --- curve -------------------------------------------------------------------------------------
def threshold_grid(df: DataFrame, score: str) -> DataFrame:
    """Gate candidates: uniform, near-one points, score quantiles, and closer ones of the top 15 %.

    One rule at every size. The result has at most 1,261 rows whatever the table; it stays a frame.
    """
    base = [i / (UNIFORM_TAUS - 1) for i in range(UNIFORM_TAUS)]
    near_one = [1.0 - 10.0 ** (-7.0 + i * 6.0 / 59.0) for i in range(60)]
    wide = [i / 399 for i in range(400)]
    top = [0.85 + 0.15 * i / 599 for i in range(600)]
    ranked = running_totals(value_counts(df, [score]), "value", ["n"])
    literal = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in base + near_one])).alias("tau"))
    quantiles = quantile_grids(ranked, [(wide, F.lit(True)), (top, F.lit(True))]).select(
        F.col("quantile").alias("tau")
    )
    return literal.union(quantiles).where("tau >= 0 and tau <= 1.000000001").distinct()


def icr_curve(df: DataFrame, score: str, attack: Column, grid: DataFrame) -> DataFrame:
    """Coverage, volume and counts per gate.

    Gates are merged into the sorted distinct scores as rows without weight, and one prefix sum
    answers all of them: no gate-by-row product, and no per-row search of the grid.
    """
    scored = df.select(F.col(score).alias("tau"), attack.alias("_a")).groupBy("tau").agg(
        F.count("*").alias("n"), F.count_if("_a").alias("a"), F.lit(False).alias("gate")
    )
    gates = grid.select("tau", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("a"), F.lit(True).alias("gate"))
    merged = scored.union(gates).groupBy("tau").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.bool_or("gate").alias("gate")
    )
    ranked = running_totals(merged, "tau", ["n", "a"]).where("gate")
    anchored, attacks = F.col("n_total") - F.col("n_before"), F.col("a_total") - F.col("a_before")
    return ranked.select(
        "tau",
        ratio(attacks, F.col("a_total"), None).alias("icr"),
        ratio(anchored, F.col("n_total"), None).alias("volume"),
        (1.0 - ratio(anchored, F.col("n_total"), None)).alias("write_reduction"),
        anchored.alias("anchored_rows"), attacks.alias("attacks_anchored"),
        F.col("a_before").alias("attacks_missed"), (anchored - attacks).alias("benign_anchored"),
        ratio(attacks, anchored, None).alias("anchor_precision"),
    )


def operating_points(curve: DataFrame, targets: list[float] | None = None) -> DataFrame:
    """Per target the gate with the least volume that still reaches it (lowest gate on a tie).

    Points that anchor nearly everything are dropped, and a gate serving several targets is listed
    once, for the most demanding one.
    """
    wanted = F.array(*[F.lit(float(t)) for t in (targets or COVERAGE_TARGETS)])
    rest = [c for c in curve.columns if c not in ("volume", "tau")]
    best = (
        curve.withColumn("target", F.explode(wanted)).where(F.col("icr") >= F.col("target"))
        .groupBy("target").agg(F.min(F.struct("volume", "tau", *rest)).alias("b"))
        .where(F.col("b.volume") < 0.999)
    )
    once = best.groupBy(F.col("b.tau").alias("tau")).agg(F.max(F.struct("target", "b")).alias("x"))
    return once.select(
        F.col("x.target").alias("target"), "tau", F.col("x.b.volume").alias("volume"),
        (1.0 / F.col("x.b.volume")).alias("reduction_factor"), *[F.col(f"x.b.{c}").alias(c) for c in rest],
    )


def per_class_coverage(
    df: DataFrame, label: str, score: str, taus: DataFrame, benign: str = "Benign"
) -> DataFrame:
    """(class, tau, support, icr, mean_confidence) for a short list of gates (operating points)."""
    gates = taus.agg(F.array_sort(F.collect_set("tau")).alias("g")).scalar()
    attacks = df.where(F.col(label) != benign).select(F.col(label).alias("class"), F.col(score).alias("_s"))
    levels = (
        attacks.withColumn("_g", gates)
        .withColumn("_level", F.size(F.filter("_g", lambda t: t <= F.col("_s"))))
        .groupBy("class", "_level").agg(F.count("*").alias("n"), F.sum("_s").alias("s"))
    )
    per_class = levels.groupBy("class").agg(
        F.sum("n").alias("support"), (F.sum("s") / F.sum("n")).alias("mean_confidence"),
        F.collect_list(F.struct("_level", "n")).alias("levels"),  # at most gates + 1 entries
    )
    rows = per_class.withColumn("_g", gates).select(
        "class", "support", "mean_confidence", "levels", F.posexplode("_g").alias("i", "tau")
    )
    covered = F.aggregate(
        F.filter("levels", lambda e: e["_level"] > F.col("i")), F.lit(0).cast("long"), lambda acc, e: acc + e["n"]
    )
    return rows.select("class", "tau", "support", ratio(covered, F.col("support")).alias("icr"), "mean_confidence")


def coverage_at_gates(df: DataFrame, score: str, attack: Column, gates: list[float]) -> DataFrame:
    """Coverage and volume for a few fixed gates in one aggregation; coverage is null without attacks."""
    s = F.col(score)
    wide = df.agg(
        F.count("*").alias("total"), F.count_if(attack).alias("attacks"),
        *[F.count_if(s >= g).alias(f"n{i}") for i, g in enumerate(gates)],
        *[F.count_if(attack & (s >= g)).alias(f"a{i}") for i, g in enumerate(gates)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(g)).alias("gate"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("a"))
        for i, g in enumerate(gates)
    ])
    return wide.select("total", "attacks", F.inline(rows)).select(
        "gate", ratio(F.col("a"), F.col("attacks"), None).alias("icr"),
        F.when(F.col("attacks") == 0, 0.0).otherwise(ratio(F.col("n"), F.col("total"))).alias("volume"),
        F.col("attacks").alias("attack_count"),
    )


def coverage_with_floors(
    df: DataFrame, category: str, score: str, attack: Column, gate: float, floors: dict[str, float]
) -> DataFrame:
    """Coverage per category where a category's own gate replaces the global one."""
    own = F.lit(float(gate))
    for name, floor in floors.items():
        own = F.when(F.col(category) == name, F.lit(float(floor))).otherwise(own)
    rows = df.where(attack).withColumn("gate_used", own)
    return rows.groupBy(F.col(category).alias("category"), "gate_used").agg(
        F.count("*").alias("attack_count"),
        F.avg((F.col(score) >= F.col("gate_used")).cast("double")).alias("icr"),
    )


def class_profile(df: DataFrame, label: str, score: str, benign: str = "Benign") -> DataFrame:
    return df.where(F.col(label) != benign).groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("support"), F.avg(score).alias("mean_confidence")
    )
