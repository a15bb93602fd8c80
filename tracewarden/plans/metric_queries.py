"""Classification metrics, ensembles and decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RUNNER_UP_MINIMUM
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import ranking as R
from . import bindings as B
from .bindings import CLASSES, with_ctes
from .catalog import query
from .rounding import rounded

_LABELS = "['Benign', 'Bot', 'DDoS', 'Infiltration']"


def _cells(spark, sf, weight=None):
    return M.confusion(B.flow(spark, sf), "category", "pred", weight)


def _class_sql(weight: str = "1") -> str:
    """Per-class counts tp, s, q and total."""
    return f"""cells AS (SELECT category AS t, pred AS p, sum({weight}) AS n FROM flow GROUP BY 1, 2),
cls AS (SELECT c, sum(n) FILTER (t = c AND p = c) AS tp, sum(n) FILTER (t = c) AS s, sum(n) FILTER (p = c) AS q, sum(n) AS total
  FROM cells, (SELECT unnest({_LABELS}) AS c) GROUP BY c),
prf AS (SELECT c, s, tp, q, total, tp / q AS pr, tp / s AS re, 2.0 * tp / (s + q) AS f1 FROM cls)"""


_W = "CASE WHEN category = 'Benign' THEN 1.0 / 0.09 ELSE 1.0 END::DOUBLE"
_MULTI = """SELECT round(sum(tp) / max(total), 6) AS accuracy, round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(pr * s) / sum(s), 6) AS precision_weighted, round(sum(re * s) / sum(s), 6) AS recall_weighted,
  round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM prf"""


@query("confusion", with_ctes("SELECT category AS y_true, pred AS y_pred, count(*) AS n FROM flow GROUP BY 1, 2", "flow"))
def confusion(spark, sf):
    return _cells(spark, sf)


@query("binary_metrics", with_ctes("""
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tn / (tn + fp), 6) AS tnr, round(fp / (tn + fp), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr FROM (SELECT
  count(*) FILTER (category <> 'Benign' AND pred <> 'Benign') AS tp, count(*) FILTER (category = 'Benign' AND pred <> 'Benign') AS fp,
  count(*) FILTER (category <> 'Benign' AND pred = 'Benign') AS fn, count(*) FILTER (category = 'Benign' AND pred = 'Benign') AS tn FROM flow)""", "flow"))
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(_cells(spark, sf)))


@query("multiclass_metrics", with_ctes("", "flow").rstrip() + f", {_class_sql()} {_MULTI}")
def multiclass_metrics(spark, sf):
    return rounded(M.multiclass_metrics(_cells(spark, sf), CLASSES))


@query("weighted_metrics", with_ctes("", "flow").rstrip() + f", {_class_sql(_W)} {_MULTI}")
def weighted_metrics(spark, sf):
    return rounded(M.multiclass_metrics(_cells(spark, sf, M.natural_prior_weight(F.col("category"))), CLASSES))


@query("mcc_kappa", with_ctes("", "flow").rstrip() + f""", {_class_sql()},
a AS (SELECT avg(re) AS ba, sum(tp)::DOUBLE AS c, max(total)::DOUBLE AS s, sum(s::DOUBLE * q) AS tq, sum(s::DOUBLE * s) AS tt, sum(q::DOUBLE * q) AS qq FROM prf)
SELECT round(ba, 6) AS balanced_accuracy, round((c * s - tq) / sqrt((s * s - qq) * (s * s - tt)), 6) AS mcc,
  round((c / s - tq / (s * s)) / (1 - tq / (s * s)), 6) AS kappa FROM a""")
def mcc_kappa(spark, sf):
    return rounded(M.agreement_metrics(_cells(spark, sf)))


_PER_CLASS = f"""{_class_sql()},
fl AS (SELECT category AS c, avg((pred <> 'Benign')::INT) AS br FROM flow GROUP BY 1),
pc AS (SELECT prf.c AS class, s::BIGINT AS support, pr AS precision, re AS recall, f1, (total - s - q + tp) / (total - s) AS tnr,
  CASE WHEN prf.c <> 'Benign' THEN br END AS binary_recall FROM prf JOIN fl USING (c))"""


@query("per_class_metrics", with_ctes("", "scored").rstrip() + f""", {_PER_CLASS},
pairs AS (SELECT category, unnest({_LABELS}) AS class, unnest([p0, p1, p2, p3]) AS score FROM scored),
sc AS (SELECT class, score, count(*) FILTER (category = class) AS pos, count(*) FILTER (category <> class) AS neg FROM pairs GROUP BY 1, 2),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY score) - neg AS below FROM sc),
au AS (SELECT class, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY 1)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(tnr, 6) AS tnr,
  round(binary_recall, 6) AS binary_recall, round(auc, 6) AS roc_auc_ovr FROM pc JOIN au USING (class)""")
def per_class_metrics(spark, sf):
    table = M.per_class_metrics(_cells(spark, sf), CLASSES)
    return rounded(table.join(_ovr(spark, sf).select("class", F.col("roc_auc").alias("roc_auc_ovr")), "class"))


def _ovr(spark, sf):
    counts = R.one_vs_rest_counts(B.scored(spark, sf), "category", F.col("prob"), CLASSES)
    return R.roc_auc(counts, ["class"])


@query("roc_auc_ovr", with_ctes("", "scored").rstrip() + f""",
pairs AS (SELECT category, unnest({_LABELS}) AS class, unnest([p0, p1, p2, p3]) AS score FROM scored),
sc AS (SELECT class, score, count(*) FILTER (category = class) AS pos, count(*) FILTER (category <> class) AS neg FROM pairs GROUP BY 1, 2),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY score) - neg AS below FROM sc),
au AS (SELECT class, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS support FROM cu GROUP BY 1)
SELECT round(avg(auc), 6) AS macro, round(sum(auc * support) / sum(support), 6) AS weighted FROM au""")
def roc_auc_ovr(spark, sf):
    auc, n = F.col("roc_auc"), F.col("support")
    return rounded(_ovr(spark, sf).agg(F.avg(auc).alias("macro"), (F.sum(auc * n) / F.sum(n)).alias("weighted")))


_BIN = """sc AS (SELECT score, count(*) FILTER (category <> 'Benign') AS pos, count(*) FILTER (category = 'Benign') AS neg FROM flow GROUP BY 1),
cu AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS np, sum(neg) OVER () AS nn, row_number() OVER (ORDER BY score DESC) AS point, count(*) OVER () AS npoints FROM sc)"""


def _counts(spark, sf):
    return R.score_counts(B.flow(spark, sf), F.col("score"), F.col("category") != "Benign")


@query("roc_auc", with_ctes("", "flow").rstrip() + f""", {_BIN}
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc, sum(pos)::BIGINT AS support FROM cu""")
def roc_auc(spark, sf):
    return rounded(R.roc_auc(_counts(spark, sf)))


@query("pr_auc", with_ctes("", "flow").rstrip() + f""", {_BIN}
SELECT round(sum(pos / np * tp / (tp + fp)), 6) AS average_precision FROM cu""")
def pr_auc(spark, sf):
    return rounded(R.average_precision(_counts(spark, sf)))


@query("roc_curve", with_ctes("", "flow").rstrip() + f""", {_BIN}
SELECT point, round(score, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cu
UNION ALL SELECT 0, NULL, 0.0, 0.0""")
def roc_curve(spark, sf):
    return rounded(R.roc_curve(_counts(spark, sf)))


@query("subtype_recall", with_ctes("""
SELECT attack, count(*) AS support, round(avg((pred <> 'Benign')::INT), 6) AS binary_recall, round(avg((pred = category)::INT), 6) AS coarse_correct
FROM flow WHERE category <> 'Benign' GROUP BY attack""", "flow"))
def subtype_recall(spark, sf):
    return rounded(M.subtype_recall(B.flow(spark, sf), "attack", "category", "pred"))


@query("error_pairs", with_ctes("SELECT category AS y_true, pred AS y_pred, count(*) AS n FROM flow WHERE category <> pred GROUP BY 1, 2", "flow"))
def error_pairs(spark, sf):
    return M.error_pairs(_cells(spark, sf))


@query("accuracy", with_ctes("""
SELECT 'coarse' AS kind, count(*) AS n, round(avg((category = pred)::INT), 6) AS accuracy FROM flow
UNION ALL SELECT 'fine', count(*), round(avg((category = pred)::INT), 6) FROM flow
UNION ALL SELECT 'binary', count(*), round(avg(((category <> 'Benign') = (pred <> 'Benign'))::INT), 6) FROM flow""", "flow"))
def accuracy(spark, sf):
    from ..operators.cleaning import literal_map

    f = B.flow(spark, sf).withColumn("label", F.when(F.col("category") == "Benign", 0).otherwise(1))
    fine = F.element_at(literal_map(B.EVENT_MAP), F.col("attack"))
    parts = [M.accuracy(f, "category", "pred", "coarse"), M.accuracy(f, "attack", "pred", "fine", fine), M.accuracy(f, "label", "pred", "binary")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("classification_report", with_ctes("", "flow").rstrip() + f""", {_PER_CLASS},
st AS (SELECT class, support, precision, recall, f1, binary_recall FROM pc
UNION ALL SELECT 'MACRO', sum(support), avg(precision), avg(recall), avg(f1), avg(binary_recall) FROM pc
UNION ALL SELECT 'WEIGHTED', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
  sum(binary_recall * support) / sum(support) FILTER (binary_recall IS NOT NULL) FROM pc)
SELECT class, support::BIGINT AS support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  round(binary_recall, 4) AS binary_recall, 'rule' AS model FROM st""")
def classification_report(spark, sf):
    table = M.per_class_metrics(_cells(spark, sf), CLASSES)
    return rounded(M.classification_report(table, "rule", ["precision", "recall", "f1", "binary_recall"]), 4)


# --- probability arrays ------------------------------------------------------------------------
_TAU = [0.5, 1.4, 0.7, 2.0]
_ARGMAX = """CASE WHEN a0 >= a1 AND a0 >= a2 AND a0 >= a3 THEN 'Benign' WHEN a1 >= a2 AND a1 >= a3 THEN 'Bot' WHEN a2 >= a3 THEN 'DDoS' ELSE 'Infiltration' END"""


@query("threshold_argmax", with_ctes(f"""
SELECT row_id, {_ARGMAX} AS chosen FROM (SELECT row_id, p0 / 0.5 AS a0, p1 / 1.4 AS a1, p2 / 0.7 AS a2, p3 / 2.0 AS a3 FROM scored)""", "scored"))
def threshold_argmax(spark, sf):
    return B.scored(spark, sf).select("row_id", V.threshold_argmax(F.col("prob"), _TAU, CLASSES).alias("chosen"))


@query("runner_up", with_ctes(f"""
SELECT row_id, label AS runner_up, round(p, 6) AS probability FROM (
  SELECT row_id, label, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) AS rn FROM (
    SELECT row_id, unnest({_LABELS}) AS label, unnest([p0, p1, p2, p3]) AS p, unnest([0, 1, 2, 3]) AS i FROM scored))
WHERE rn = 2 AND p > 0.15""", "scored"))
def runner_up(spark, sf):
    second = V.runner_up(F.col("prob"), CLASSES, RUNNER_UP_MINIMUM)
    return B.scored(spark, sf).withColumn("s", second).where(F.col("s").isNotNull()).select(
        "row_id", F.col("s.label").alias("runner_up"), F.round("s.probability", 6).alias("probability"))


# a second model: the same mass with the classes in another order
_OTHER = ["DDoS", "Benign", "Infiltration", "Bot"]
_VOTE = f"""other AS (SELECT row_id, CAST(w2 + row_id % 3 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 + row_id % 3 AS DOUBLE) AS q2, CAST(w0 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 + row_id % 3 AS DOUBLE) AS q0,
  CAST(w3 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 + row_id % 3 AS DOUBLE) AS q3, CAST(w1 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 + row_id % 3 AS DOUBLE) AS q1 FROM weights),
vote AS (SELECT row_id, category, (p0 + q0) / 2.0 AS a0, (p1 + q1) / 2.0 AS a1, (p2 + q2) / 2.0 AS a2, (p3 + q3) / 2.0 AS a3 FROM scored JOIN other USING (row_id))"""


def _other_model(spark, sf):
    """Second model's predictions, kept in its own label order."""
    s, bump = B.scored(spark, sf), F.col("row_id") % 3
    total = (F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3") + bump).cast("double")
    member = lambda c: c.cast("double") / total
    return s.select("row_id", F.array(
        member(F.col("w2") + bump), member(F.col("w0")), member(F.col("w3")), member(F.col("w1"))).alias("other"))


def _vote(spark, sf):
    both = B.scored(spark, sf).join(_other_model(spark, sf), "row_id")
    return both.withColumn("vote", V.mean_arrays([F.col("prob"), V.reorder(F.col("other"), _OTHER, CLASSES)]))


@query("soft_vote", with_ctes("", "scored").rstrip() + f""", {_VOTE}
SELECT row_id, round(a0, 6) AS p_benign, round(a1, 6) AS p_bot, round(a2, 6) AS p_ddos, round(a3, 6) AS p_infiltration, {_ARGMAX} AS pred FROM vote""")
def soft_vote(spark, sf):
    v = _vote(spark, sf)
    names = ["p_benign", "p_bot", "p_ddos", "p_infiltration"]
    return v.select(
        "row_id", *[F.round(F.get("vote", F.lit(i)), 6).alias(n) for i, n in enumerate(names)],
        V.threshold_argmax(F.col("vote"), [1.0] * 4, CLASSES).alias("pred"))


@query("cascade_compose", with_ctes("""
SELECT row_id, round(1.0::DOUBLE - (1.0::DOUBLE - p0), 6) AS p_benign, round((1.0::DOUBLE - p0) * (w1::DOUBLE / (w1 + w2 + w3)), 6) AS p_bot,
  round((1.0::DOUBLE - p0) * (w2::DOUBLE / (w1 + w2 + w3)), 6) AS p_ddos, round((1.0::DOUBLE - p0) * (w3::DOUBLE / (w1 + w2 + w3)), 6) AS p_infiltration FROM scored""", "scored"))
def cascade_compose(spark, sf):
    s = B.scored(spark, sf)
    attack_total = (F.col("w1") + F.col("w2") + F.col("w3")).cast("double")
    named = F.array(*[F.col(f"w{i}").cast("double") / attack_total for i in (1, 2, 3)])
    composed = V.cascade(F.lit(1.0) - F.col("p0"), named, CLASSES)
    names = ["p_benign", "p_bot", "p_ddos", "p_infiltration"]
    return s.withColumn("c", composed).select("row_id", *[F.round(F.get("c", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


@query("model_ranking", with_ctes("", "scored").rstrip() + f""", {_VOTE},
stack AS (SELECT 'rule' AS model, category AS t, pred AS p FROM flow UNION ALL SELECT 'vote', category, {_ARGMAX} FROM vote),
c AS (SELECT model, c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS s, count(*) FILTER (p = c) AS q
  FROM stack, (SELECT unnest({_LABELS}) AS c) GROUP BY model, c),
m AS (SELECT model, sum(tp) / sum(s) AS accuracy, avg(2.0 * tp / (s + q)) AS f1_macro FROM c GROUP BY model),
b AS (SELECT model, 2.0 * count(*) FILTER (t <> 'Benign' AND p <> 'Benign') / (count(*) FILTER (t <> 'Benign') + count(*) FILTER (p <> 'Benign')) AS binary_f1,
  count(*) FILTER (t = 'Benign' AND p <> 'Benign') / count(*) FILTER (t = 'Benign') AS fpr FROM stack GROUP BY model)
SELECT model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(binary_f1, 6) AS binary_f1, round(fpr, 6) AS fpr FROM m JOIN b USING (model)""")
def model_ranking(spark, sf):
    rule = B.flow(spark, sf).select(F.lit("rule").alias("model"), F.col("category").alias("y_true"), F.col("pred").alias("y_pred"))
    vote = _vote(spark, sf).select(
        F.lit("vote").alias("model"), F.col("category").alias("y_true"), V.threshold_argmax(F.col("vote"), [1.0] * 4, CLASSES).alias("y_pred"))
    return rounded(M.model_ranking(rule.unionByName(vote), CLASSES).select("model", "accuracy", "f1_macro", "binary_f1", "fpr"))


@query("class_weights", with_ctes("""
SELECT category, n, round(total::DOUBLE / (k * n), 6) AS weight FROM (SELECT category, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k
  FROM flow GROUP BY category)""", "flow"))
def class_weights(spark, sf):
    return rounded(M.class_weights(B.flow(spark, sf), "category"))
