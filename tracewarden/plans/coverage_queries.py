"""Gates, coverage curves and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COVERAGE_TARGETS
from ..operators import coverage as C
from ..operators import reports
from ..operators.gate import anchor_flag, anchor_lookup, follow_source
from ..operators.ranking import roc_auc, score_counts
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .rounding import rounded


def _attack():
    return F.col("category") != "Benign"


_EDGES = "[" + ", ".join(repr(e) for e in C.bin_edges()) + "]"
_ALL_EDGES = "[" + ", ".join(repr(e) for e in [0.0, *C.bin_edges(), 1.0]) + "]"
_WIDE = "[" + ", ".join(repr(i / 399) for i in range(400)) + "]"
_TOP = "[" + ", ".join(repr(0.85 + 0.15 * i / 599) for i in range(600)) + "]"
_BASE = "[" + ", ".join(repr(t) for t in [i / 200 for i in range(201)] + [1.0 - 10.0 ** (-7.0 + i * 6.0 / 59.0) for i in range(60)]) + "]"
_TARGETS = "[" + ", ".join(str(t) for t in COVERAGE_TARGETS) + "]"

_CURVE = f"""
grid AS (SELECT DISTINCT tau FROM (
    SELECT unnest({_BASE}::DOUBLE[]) AS tau
    UNION ALL SELECT unnest(quantile_cont(score, {_WIDE}::DOUBLE[])) FROM flow
    UNION ALL SELECT unnest(quantile_cont(score, {_TOP}::DOUBLE[])) FROM flow) WHERE tau >= 0 AND tau <= 1.000000001),
counts AS (SELECT score, count(*) AS n, count(*) FILTER (category <> 'Benign') AS a FROM flow GROUP BY score),
cum AS (SELECT tau, sum(n) AS n, sum(a) AS a FROM grid JOIN counts ON score >= tau GROUP BY tau),
tot AS (SELECT count(*) AS n, count(*) FILTER (category <> 'Benign') AS a FROM flow),
curve AS (SELECT tau, coalesce(cum.a, 0) / tot.a AS icr, coalesce(cum.n, 0) / tot.n AS volume,
    1.0::DOUBLE - coalesce(cum.n, 0) / tot.n AS write_reduction,
    coalesce(cum.n, 0)::BIGINT AS anchored_rows, coalesce(cum.a, 0)::BIGINT AS attacks_anchored,
    (tot.a - coalesce(cum.a, 0))::BIGINT AS attacks_missed, (coalesce(cum.n, 0) - coalesce(cum.a, 0))::BIGINT AS benign_anchored,
    CASE WHEN coalesce(cum.n, 0) > 0 THEN cum.a / cum.n END AS anchor_precision
  FROM grid LEFT JOIN cum USING (tau) CROSS JOIN tot)"""

_POINTS = f"""
best AS (SELECT target, tau, volume, icr, write_reduction, anchored_rows, attacks_anchored, attacks_missed, benign_anchored, anchor_precision
  FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY volume, tau) AS rn
        FROM curve, (SELECT unnest({_TARGETS}::DOUBLE[]) AS target) WHERE icr >= target) WHERE rn = 1 AND volume < 0.999),
points AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY target DESC) AS rn FROM best) WHERE rn = 1)"""


def _curve(spark, sf):
    f = B.flow(spark, sf)
    return C.icr_curve(f, "score", _attack(), C.threshold_grid(f, "score"))


@query("icr_curve", with_ctes("", "flow").rstrip() + f""", {_CURVE}
SELECT round(tau, 6) AS tau, round(icr, 6) AS icr, round(volume, 6) AS volume, round(write_reduction, 6) AS write_reduction,
  anchored_rows, attacks_anchored, attacks_missed, benign_anchored, round(anchor_precision, 6) AS anchor_precision FROM curve""")
def icr_curve(spark, sf):
    return rounded(_curve(spark, sf))


@query("operating_points", with_ctes("", "flow").rstrip() + f""", {_CURVE}, {_POINTS}
SELECT target, round(tau, 6) AS tau, round(volume, 6) AS volume, round(1.0 / volume, 6) AS reduction_factor, round(icr, 6) AS icr,
  round(write_reduction, 6) AS write_reduction, anchored_rows, attacks_anchored, attacks_missed, benign_anchored,
  round(anchor_precision, 6) AS anchor_precision FROM points""")
def operating_points(spark, sf):
    return rounded(C.operating_points(_curve(spark, sf)))


@query("metric_lookup", with_ctes("", "flow").rstrip() + f""", {_CURVE}, {_POINTS}
SELECT target, round(tau, 6) AS tau, round(icr, 6) AS icr, round(volume, 6) AS volume FROM points WHERE abs(target - 0.95) < 1e-9""")
def metric_lookup(spark, sf):
    points = C.operating_points(_curve(spark, sf))
    return rounded(reports.metric_lookup(points, "target", 0.95).select("target", "tau", "icr", "volume"))


@query("icr_per_class", with_ctes("", "flow").rstrip() + f""", {_CURVE}, {_POINTS}
SELECT category AS class, round(tau, 6) AS tau, count(*) AS support, round(avg((score >= tau)::INT), 6) AS icr,
  round(avg(score), 6) AS mean_confidence
FROM flow, (SELECT DISTINCT tau FROM points) WHERE category <> 'Benign' GROUP BY category, points.tau""".replace("points.tau", "tau"))
def icr_per_class(spark, sf):
    f = B.flow(spark, sf)
    points = C.operating_points(C.icr_curve(f, "score", _attack(), C.threshold_grid(f, "score")))
    return rounded(C.per_class_coverage(f, "category", "score", points))


_GATES = [0.3, 0.5, 0.6, 0.8, 0.9]


@query("icr_gate", with_ctes("""
SELECT gate, round(count(*) FILTER (category <> 'Benign' AND score >= gate) / count(*) FILTER (category <> 'Benign'), 6) AS icr,
  round(count(*) FILTER (score >= gate) / count(*), 6) AS volume, count(*) FILTER (category <> 'Benign') AS attack_count
FROM flow, (SELECT unnest([0.3, 0.5, 0.6, 0.8, 0.9]::DOUBLE[]) AS gate) GROUP BY gate""", "flow"))
def icr_gate(spark, sf):
    return rounded(C.coverage_at_gates(B.flow(spark, sf), "score", _attack(), _GATES))


@query("icr_floors", with_ctes("""
SELECT category, CASE WHEN category = 'Infiltration' THEN 0.3 ELSE 0.6 END::DOUBLE AS gate_used, count(*) AS attack_count,
  round(avg((score >= CASE WHEN category = 'Infiltration' THEN 0.3 ELSE 0.6 END)::INT), 6) AS icr
FROM flow WHERE category <> 'Benign' GROUP BY category""", "flow"))
def icr_floors(spark, sf):
    return rounded(C.coverage_with_floors(B.flow(spark, sf), "category", "score", _attack(), 0.6, {"Infiltration": 0.3}))


_BINNED = f"""binned AS (SELECT len(list_filter({_EDGES}::DOUBLE[], lambda e: e <= score)) AS bin, score, (category <> 'Benign')::INT::DOUBLE AS y FROM flow)"""


@query("reliability", with_ctes("", "flow").rstrip() + f""", {_BINNED},
stats AS (SELECT bin, count(*) AS n, avg(score) AS c, avg(y) AS f FROM binned GROUP BY bin)
SELECT b.bin::INT AS bin, ({_ALL_EDGES}::DOUBLE[])[b.bin + 1] AS bin_lo_raw, ({_ALL_EDGES}::DOUBLE[])[b.bin + 2] AS bin_hi_raw,
  coalesce(n, 0) AS count, round(c, 6) AS mean_confidence, round(f, 6) AS observed_frequency, round(abs(c - f), 6) AS gap
FROM (SELECT unnest(range(15)) AS bin) b LEFT JOIN stats ON stats.bin = b.bin""".replace("bin_lo_raw", "bin_lo").replace("bin_hi_raw", "bin_hi"))
def reliability(spark, sf):
    table = C.reliability(B.flow(spark, sf), "score", _attack())
    return table.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "observed_frequency", "gap")})


@query("ece", with_ctes("", "flow").rstrip() + f""", {_BINNED},
stats AS (SELECT bin, count(*) AS n, avg(score) AS c, avg(y) AS f, sum((score - y) * (score - y)) AS sq FROM binned GROUP BY bin)
SELECT round(sum(n * abs(c - f)) / sum(n), 6) AS ece, round(max(abs(c - f)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM stats""")
def ece(spark, sf):
    return rounded(C.calibration_error(B.flow(spark, sf), "score", _attack()))


_METHODS = """methods AS (SELECT unnest(['raw', 'sharpened', 'flattened']) AS method, score, category,
    unnest([score, score * score, score / 2.0 + 0.25]) AS s FROM flow)"""


def _methods(spark, sf):
    s = F.col("score")
    variants = {"raw": s, "sharpened": s * s, "flattened": s / 2.0 + 0.25}
    rows = F.array(*[F.struct(F.lit(m).alias("method"), v.alias("s")) for m, v in variants.items()])
    return B.flow(spark, sf).select("category", F.inline(rows))


@query("calibration_rank", with_ctes("", "flow").rstrip() + f""", {_METHODS},
b AS (SELECT method, len(list_filter({_EDGES}::DOUBLE[], lambda e: e <= s)) AS bin, s, (category <> 'Benign')::INT::DOUBLE AS y FROM methods),
st AS (SELECT method, bin, count(*) AS n, avg(s) AS c, avg(y) AS f, sum((s - y) * (s - y)) AS sq FROM b GROUP BY method, bin),
e AS (SELECT method, sum(n * abs(c - f)) / sum(n) AS ece, max(abs(c - f)) AS mce, sum(sq) / sum(n) AS brier FROM st GROUP BY method),
sc AS (SELECT method, s, count(*) FILTER (category <> 'Benign') AS pos, count(*) FILTER (category = 'Benign') AS neg FROM methods GROUP BY method, s),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY method ORDER BY s) - neg AS below FROM sc),
au AS (SELECT method, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM cu GROUP BY method)
SELECT method, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier, round(roc_auc, 6) AS roc_auc,
  row_number() OVER (ORDER BY ece, method) AS rank, (SELECT max(roc_auc) - min(roc_auc) FROM au) < 1e-4 AS rank_preserving
FROM e JOIN au USING (method)""")
def calibration_rank(spark, sf):
    m = _methods(spark, sf)
    errors = C.calibration_error(m, "s", _attack(), by=["method"])
    aucs = roc_auc(score_counts(m, F.col("s"), _attack(), ["method"]), ["method"]).select("method", "roc_auc")
    return rounded(C.calibration_rank(errors, aucs))


# some confidences are NaN, some null: neither is ever anchored
_SILENT = "(row_id % 101 = 7 OR row_id % 103 = 9)"


def _with_gaps(confidence):
    return F.when(F.col("row_id") % 101 == 7, float("nan")).when(F.col("row_id") % 103 != 9, confidence)


@query("anchor_flag", with_ctes(f"SELECT row_id, round(score, 6) AS confidence, score >= 0.6 AND NOT {_SILENT} AS anchor FROM flow", "flow"))
def anchor_flags(spark, sf):
    f = B.flow(spark, sf)
    return f.select("row_id", F.round("score", 6).alias("confidence"), anchor_flag(_with_gaps(F.col("score")), B.TAU).alias("anchor"))


@query("gate_decision", with_ctes(
    f"SELECT event_id, threat_class AS threat_category, confidence, CASE WHEN {_SILENT} THEN 'off_chain_only' ELSE decision END AS decision FROM decided", "decided"))
def gate_decision(spark, sf):
    a = B.alerts(spark, sf)
    decision = B.POLICY.decide(
        F.when(F.col("threat_class") == "Benign", "BENIGN").otherwise("ATTACK"), F.col("threat_class"), _with_gaps(F.col("confidence"))
    )
    return a.select("event_id", F.col("threat_class").alias("threat_category"), "confidence", decision.alias("decision"))


@query("anchor_lookup", with_ctes("SELECT event_id, event_severity AS severity, anchor FROM evidence", "evidence"))
def anchor_lookups(spark, sf):
    e = B.evidence_events(spark, sf).select("event_id", F.col("event.severity").alias("severity"))
    return anchor_lookup(e, B.alerts(spark, sf).select("event_id", "anchor"))


@query("source_gate", with_ctes("""
SELECT event_id, CASE WHEN NOT anchor THEN 'off_chain_only' WHEN event_severity = 'critical' THEN 'immediate' ELSE 'batch' END AS decision
FROM evidence""", "evidence"))
def source_gate(spark, sf):
    e = anchor_lookups(spark, sf)
    return e.select("event_id", follow_source(F.col("anchor"), F.col("severity")).alias("decision"))
