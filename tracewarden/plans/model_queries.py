"""Queries that fit models; checked by rows, since fits are not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, learners as L
from ..functions.vectors import threshold_argmax
from ..operators import coverage as C
from ..operators import isotonic as isotonic_fit
from ..operators import metrics as M
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .rounding import rounded

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_BENIGN = "N"


def _split(spark, sf, name):
    return B.lines(spark, sf).where(F.col("split") == name)


def _forest(spark, sf):
    return L.fit_forest(_split(spark, sf, "train"), _FEATURES, "category", B.LINE_CLASSES)


@query("label_rejects", with_ctes("SELECT attack AS label, count(*) AS n FROM flow WHERE attack NOT IN ('view', 'click') OR attack IS NULL GROUP BY 1", "flow"))
def label_rejects(spark, sf):
    return L.label_rejects(B.flow(spark, sf), "attack", ["view", "click"])


@query("compare_models")
def compare_models(spark, sf):
    return rounded(L.compare_models(_split(spark, sf, "train"), _split(spark, sf, "test"), _FEATURES, "category", B.LINE_CLASSES, _BENIGN))


@query("rf_importance")
def rf_importance(spark, sf):
    return L.feature_importance(_split(spark, sf, "train"), [*_FEATURES, "const_feature"], "category", B.LINE_CLASSES)


@query("permutation_importance")
def permutation_importance(spark, sf):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    val = _split(spark, sf, "val").withColumn("row_id", key)
    return L.permutation_importance(_forest(spark, sf), val, "row_id", _FEATURES, "category", B.LINE_CLASSES)


@query("selected_vs_full")
def selected_vs_full(spark, sf):
    return L.selected_vs_full(
        _split(spark, sf, "train"), _split(spark, sf, "test"), _FEATURES[:2], B.LINE_FEATURES, "category", B.LINE_CLASSES)


@query("hyper_search")
def hyper_search(spark, sf):
    return L.hyper_search(_split(spark, sf, "train"), _FEATURES, "category", B.LINE_CLASSES)


def _attack():
    return F.col("category") != "Benign"


@query("isotonic")
def isotonic(spark, sf):
    """Calibration error before and after isotonic regression fitted on even rows."""
    f = B.flow(spark, sf)
    model = L.fit_isotonic(f.where("row_id % 2 = 0"), "score", _attack())
    held = L.apply_isotonic(model, f.where("row_id % 2 = 1"), "score")
    raw = C.calibration_error(held, "score", _attack()).withColumn("method", F.lit("raw"))
    return raw.unionByName(C.calibration_error(held, "calibrated", _attack()).withColumn("method", F.lit("isotonic")))


@query("isotonic_blocks", with_ctes("", "flow").rstrip() + """,
d AS (SELECT floor(score * 100)::DOUBLE AS s, count(*) AS n, count(*) FILTER (category <> 'Benign') AS y FROM flow GROUP BY 1),
c AS (SELECT s, n, y, sum(n) OVER (ORDER BY s) AS wn, sum(y) OVER (ORDER BY s) AS wy, row_number() OVER (ORDER BY s) AS i FROM d),
m AS (SELECT a.i AS a, i.i AS i, min((b.wy - a.wy + a.y)::DOUBLE / (b.wn - a.wn + a.n)::DOUBLE) AS m FROM c a JOIN c i ON a.i <= i.i JOIN c b ON b.i >= i.i GROUP BY 1, 2),
v AS (SELECT i, max(m) AS v FROM m GROUP BY i),
b AS (SELECT v, min(s) AS low, max(s) AS high, sum(n)::BIGINT AS n, sum(y)::BIGINT AS positives FROM c JOIN v USING (i) GROUP BY v)
SELECT row_number() OVER (ORDER BY v) - 1 AS block, low, high, n, positives, positives / n AS value FROM b""")
def isotonic_blocks(spark, sf):
    """Blocks of the isotonic fit over all rows, scores in hundredths; the SQL takes the largest of the least means."""
    f = B.flow(spark, sf).withColumn("s", F.floor(F.col("score") * 100).cast("double"))
    return isotonic_fit.isotonic_blocks(f, "s", _attack())


@query("platt")
def platt(spark, sf):
    f = B.flow(spark, sf)
    slope, intercept = L.fit_platt(f.where("row_id % 2 = 0"), "score", _attack())
    held = f.where("row_id % 2 = 1").withColumn("calibrated", L.apply_platt(slope, intercept, F.col("score")))
    return C.calibration_error(held, "calibrated", _attack()).withColumn("method", F.lit("platt"))


@query("fit_thresholds")
def fit_thresholds(spark, sf):
    """Fitted on even rows; ``macro_f1`` is that of the odd rows."""
    rows = B.scored(spark, sf)
    tau, _ = L.fit_thresholds(rows.where("row_id % 2 = 0"), "prob", "category", B.CLASSES)
    held = rows.where("row_id % 2 = 1").withColumn("y_pred", threshold_argmax(F.col("prob"), tau, B.CLASSES))
    score = M.multiclass_metrics(M.confusion(held, "category", "y_pred"), B.CLASSES).select("f1_macro").scalar()
    table = spark.createDataFrame([(c, float(t)) for c, t in zip(B.CLASSES, tau)], "class string, threshold double")
    return table.withColumn("macro_f1", F.round(score, 6))


@query("score_batch")
def score_batch(spark, sf):
    """The test fold, scored by a forest of the train fold and calibrated on the val fold."""
    model, medians = _forest(spark, sf), cleaning.fit_medians(_split(spark, sf, "train"), _FEATURES)
    calibrator = L.fit_calibrator(_split(spark, sf, "val"), model, _FEATURES, "category", B.LINE_CLASSES, medians, _BENIGN)
    out = L.score_batch(
        _split(spark, sf, "test"), model, _FEATURES, B.LINE_CLASSES, [1.0, 1.0, 1.0], B.TAU, medians, _BENIGN, calibrator)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "predicted_class", "confidence", "severity", "anchor")


@query("occlusion_attributions")
def occlusion(spark, sf):
    train = _split(spark, sf, "train")
    medians = {r["feature"]: r["median"] for r in cleaning.fit_medians(train, _FEATURES).collect()}  # one per feature
    out = L.occlusion_attributions(_split(spark, sf, "test"), _forest(spark, sf), _FEATURES, B.LINE_CLASSES, medians)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "predicted_class", F.posexplode("attributions").alias("rank", "a")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "predicted_class", "rank", "a.feature", F.col("a.shap").alias("contribution"))
