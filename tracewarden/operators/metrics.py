"""Classification metrics as closed forms over confusion cells.

The only pass over the rows is the grouped count of (truth, prediction); everything else works on
at most classes x classes cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN_KEEP_FRACTION


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, with ``empty`` (or null) where the denominator is zero."""
    value = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def confusion(
    df: DataFrame, truth: str = "y_true", pred: str = "y_pred", weight: Column | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """(by, y_true, y_pred, n). With a weight, n is the weight sum."""
    measure = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*(by or []), F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(measure.alias("n"))


def natural_prior_weight(truth: Column, keep: float = BENIGN_KEEP_FRACTION) -> Column:
    """Undo benign downsampling: each benign row counts 1/keep. Only for folds that were sampled."""
    return F.when(truth == "Benign", F.lit(1.0 / keep)).otherwise(F.lit(1.0))


def class_cells(cells: DataFrame, labels: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, class, tp, support, predicted, total). With a label list, absent classes give zeros."""
    by = by or []
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    if labels is None:
        totals = cells.groupBy(*by).agg(F.sum("n").alias("total"))
        roles = cells.select(*by, "n", F.inline(F.array(
            F.struct(t.alias("class"), F.lit(True).alias("truth"), (t == p).alias("hit")),
            F.struct(p.alias("class"), F.lit(False).alias("truth"), F.lit(False).alias("hit")),
        )))
        per = roles.groupBy(*by, "class").agg(
            F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("truth"), n).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("truth"), n).otherwise(0)).alias("predicted"),
        )
        if by:
            return per.join(totals, by)
        return per.withColumn("total", totals.scalar())
    wide = cells.groupBy(*by).agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when((t == c) & (p == c), n).otherwise(0)).alias(f"tp{i}") for i, c in enumerate(labels)],
        *[F.sum(F.when(t == c, n).otherwise(0)).alias(f"s{i}") for i, c in enumerate(labels)],
        *[F.sum(F.when(p == c, n).otherwise(0)).alias(f"p{i}") for i, c in enumerate(labels)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"s{i}").alias("support"),
                 F.col(f"p{i}").alias("predicted"))
        for i, c in enumerate(labels)
    ])
    return wide.select(*by, F.inline(rows), "total")


def _prf() -> tuple[Column, Column, Column]:
    tp, s, q = F.col("tp"), F.col("support"), F.col("predicted")
    return ratio(tp, q), ratio(tp, s), ratio(2 * tp, s + q)


def per_class_metrics(
    cells: DataFrame, labels: list[str], by: list[str] | None = None, benign: str = "Benign"
) -> DataFrame:
    """Support, precision, recall, F1, TNR and the share detected as any attack; absent classes drop out."""
    by = by or []
    precision, recall, f1 = _prf()
    tn = F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")
    table = class_cells(cells, labels, by).where(F.col("support") > 0)
    flagged = cells.groupBy(*by, F.col("y_true").alias("class")).agg(
        F.sum(F.when(F.col("y_pred") != benign, F.col("n")).otherwise(0)).alias("_flagged")
    )
    return table.join(flagged, [*by, "class"]).select(
        *by, "class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        ratio(tn, F.col("total") - F.col("support"), None).alias("tnr"),
        F.when(F.col("class") != benign, ratio(F.col("_flagged"), F.col("support"))).alias("binary_recall"),
    )


def per_class_f1(cells: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, class, f1) as in ``per_class_metrics``, from one aggregation of the cells."""
    f1 = _prf()[2]
    return class_cells(cells, labels, by).where(F.col("support") > 0).select(*(by or []), "class", f1.alias("f1"))


def multiclass_metrics(cells: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted precision, recall and F1 over the given labels."""
    by = by or []
    precision, recall, f1 = _prf()
    table = class_cells(cells, labels, by).withColumns({"p": precision, "r": recall, "f": f1})
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return table.groupBy(*by).agg(
        ratio(F.sum("tp"), F.max("total")).alias("accuracy"),
        F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"), F.avg("f").alias("f1_macro"),
        weighted("p").alias("precision_weighted"), weighted("r").alias("recall_weighted"),
        weighted("f").alias("f1_weighted"),
    )


def binary_metrics(cells: DataFrame, by: list[str] | None = None, benign: str = "Benign") -> DataFrame:
    """Attack-versus-benign counts and rates."""
    attack, flagged, n = F.col("y_true") != benign, F.col("y_pred") != benign, F.col("n")
    pick = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    counts = cells.groupBy(*(by or [])).agg(
        pick(attack & flagged).alias("tp"), pick(~attack & flagged).alias("fp"),
        pick(attack & ~flagged).alias("fn"), pick(~attack & ~flagged).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp, None).alias("tnr"),
        ratio(fp, tn + fp, None).alias("fpr"), ratio(fn, tp + fn, None).alias("fnr"),
    )


def agreement_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Balanced accuracy, multiclass MCC and Cohen's kappa."""
    table = class_cells(cells, by=by).withColumns({
        c: F.col(c).cast("double") for c in ("tp", "support", "predicted", "total")
    })
    sums = table.groupBy(*(by or [])).agg(
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"),
        F.sum("tp").alias("c"), F.max("total").alias("s"),
        F.sum(F.col("support") * F.col("predicted")).alias("tq"),
        F.sum(F.col("support") * F.col("support")).alias("tt"),
        F.sum(F.col("predicted") * F.col("predicted")).alias("qq"),
    )
    c, s, tq, tt, qq = (F.col(x) for x in ("c", "s", "tq", "tt", "qq"))
    chance = tq / (s * s)
    return sums.select(
        *(by or []), "balanced_accuracy",
        ratio(c * s - tq, F.sqrt((s * s - qq) * (s * s - tt))).alias("mcc"),
        ratio(c / s - chance, 1 - chance, None).alias("kappa"),
    )


def subtype_recall(df: DataFrame, fine: str, truth: str, pred: str, benign: str = "Benign") -> DataFrame:
    """Per fine attack label: support, detected as any attack, and named correctly."""
    return df.where(F.col(truth) != benign).groupBy(fine).agg(
        F.count("*").alias("support"),
        F.avg((F.col(pred) != benign).cast("double")).alias("binary_recall"),
        F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("coarse_correct"),
    )


def error_pairs(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("y_true") != F.col("y_pred"))


def accuracy(df: DataFrame, truth: str, pred: str, kind: str, mapping: Column | None = None) -> DataFrame:
    """Accuracy against coarse truth, mapped fine truth, or the binary view."""
    t, p = F.col(truth), F.col(pred)
    if kind == "coarse":
        hit = t == p
    elif kind == "fine":
        hit = mapping == p
    else:
        hit = (t.cast("int") != 0) == (p != "Benign")
    return df.agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy")).withColumn("kind", F.lit(kind))


def model_ranking(predictions: DataFrame, labels: list[str], model: str = "model") -> DataFrame:
    """One row per model over stacked predictions, for sorting by macro-F1."""
    cells = confusion(predictions, by=[model])
    multi = multiclass_metrics(cells, labels, [model])
    binary = binary_metrics(cells, [model]).select(model, F.col("f1").alias("binary_f1"), "fpr")
    return multi.join(binary, model)


def classification_report(per_class: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """Detail rows plus MACRO and WEIGHTED rows; averages ignore nulls."""
    s = F.col("support")
    macro = per_class.agg(F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in columns])
    weighted = per_class.agg(F.sum("support").alias("support"), *[
        ratio(F.sum(F.col(c) * s), F.sum(F.when(F.col(c).isNotNull(), s)), None).alias(c) for c in columns
    ])
    shape = ["class", "support", *columns]
    stacked = (
        per_class.select(*shape)
        .unionByName(macro.withColumn("class", F.lit("MACRO")).select(*shape))
        .unionByName(weighted.withColumn("class", F.lit("WEIGHTED")).select(*shape))
    )
    return stacked.withColumn("model", F.lit(model))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_w", whole).select(
        label, "n", (F.col("_w.n").cast("double") / (F.col("_w.k") * F.col("n")).cast("double")).alias("weight")
    )
