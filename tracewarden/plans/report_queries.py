"""Sizes, latencies, throughput, loss accounting and serving views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.canonical import with_canonical_json
from ..operators import coverage as C
from ..operators import ledger as G
from ..operators import metrics as M
from ..operators import reports as R
from ..streaming import retry, serving
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .evidence_queries import stored_payloads
from .rounding import rounded

_RECORD = """'{"cloud_resource_id":' || coalesce('"' || cloud_resource_id || '"', 'null') || ',"confidence":' || CAST(confidence AS VARCHAR) || ',"event_hash":"' || event_hash ||
  '","event_id":"' || event_id || '","model_version":"' || model_version || '","severity":"' || severity || '","threat_class":"' || threat_class || '","timestamp":"' || timestamp || '"}'"""
_SIZES = f"sz AS (SELECT octet_length(encode({_RECORD})) AS r, octet_length(encode(payload)) AS p, anchor FROM evidence)"


def _sizes(spark, sf):
    p = stored_payloads(spark, sf).withColumn("record", F.struct(*K.COMMITTED_FIELDS))
    return R.storage_overhead(with_canonical_json(p, "record", "record_text", floats="six"), F.col("record_text"), F.col("payload"))


@query("storage_overhead", with_ctes("", "evidence").rstrip() + f""", {_SIZES}
SELECT count(*) AS n, round(avg(r), 6) AS record_bytes_mean, max(r) AS record_bytes_max, round(avg(p), 6) AS payload_bytes_mean, max(p) AS payload_bytes_max,
  round(100.0 * (1.0 - avg(r) / avg(p)), 6) AS reduction_pct FROM sz""")
def storage_overhead(spark, sf):
    return rounded(_sizes(spark, sf))


def _anchor_rate(spark, sf):
    return B.flow(spark, sf).agg(F.avg((F.col("score") >= B.TAU).cast("double")).alias("anchor_rate"))


@query("write_reduction", with_ctes("", "evidence").rstrip() + f""", {_SIZES}
SELECT 99.0::DOUBLE AS transaction_reduction_pct, round(100.0 * (1.0 - avg(r) / avg(p)), 6) AS record_reduction_pct, round(avg(anchor::INT), 6) AS anchoring_rate,
  round(100.0 * (1.0 - avg(anchor::INT) * (avg(r) / avg(p))), 6) AS combined_reduction_pct FROM sz""")
def write_reduction(spark, sf):
    return rounded(R.write_reduction(_sizes(spark, sf), _anchor_rate(spark, sf).scalar()))


@query("capacity_table", with_ctes("""
SELECT arrival_per_sec, round(rate, 6) AS anchor_rate, round(arrival_per_sec * rate, 2) AS anchors_per_sec, batch_factor,
  round(arrival_per_sec * rate / batch_factor, 3) AS required_per_sec, arrival_per_sec * rate / batch_factor <= 1000 AS within_target
FROM (SELECT avg((score >= 0.6)::INT) AS rate FROM flow), (SELECT unnest([100, 500, 1000, 5000, 10000]::BIGINT[]) AS arrival_per_sec),
  (SELECT unnest([1, 10, 100, 500]::BIGINT[]) AS batch_factor)""", "flow"))
def capacity_table(spark, sf):
    return R.capacity_table(_anchor_rate(spark, sf))


@query("batch_factor", with_ctes("""
SELECT round(10000 * avg((score >= 0.6)::INT), 6) AS anchored_per_sec, greatest(1, ceil(10000 * avg((score >= 0.6)::INT) / 1000))::BIGINT AS batch_factor FROM flow""", "flow"))
def batch_factor(spark, sf):
    rate = F.col("anchor_rate") * 10000
    return rounded(_anchor_rate(spark, sf).select(rate.alias("anchored_per_sec"), R.batch_factor(rate).alias("batch_factor")))


@query("latency_percentiles", with_ctes("""
SELECT outcome, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99,
  round(max(latency_ms), 6) AS max, round(list_sort(list(latency_ms))[(99 * count(*) + 99) // 100], 6) AS p99_nearest, count(*) AS n FROM outcomes GROUP BY outcome""", "outcomes"))
def latency_percentiles(spark, sf):
    return rounded(R.latency_percentiles(B.outcomes(spark, sf), "latency_ms", ["outcome"]))


@query("throughput", with_ctes("""
SELECT user_id % 8 AS run, count(*) AS n, round(max(finished_sec) - min(enqueued_sec), 3) AS elapsed_sec, round(count(*) / (max(finished_sec) - min(enqueued_sec)), 6) AS per_second
FROM outcomes GROUP BY 1""", "outcomes"))
def throughput(spark, sf):
    o = B.outcomes(spark, sf).withColumn("run", F.col("user_id") % 8)
    t = R.throughput(o, F.col("enqueued_sec"), F.col("finished_sec"), ["run"])
    return t.withColumns({"elapsed_sec": F.round("elapsed_sec", 3), "per_second": F.round("per_second", 6)})


# some outcomes are missing, some written twice; some ids are submitted again, most of those rejected
_LOSS = "o AS (SELECT * FROM outcomes WHERE event_id % 1009 <> 7 UNION ALL SELECT * FROM outcomes WHERE event_id % 2003 = 5)"


@query("loss_accounting", with_ctes("", "outcomes").rstrip() + f""", {_LOSS},
i AS (SELECT e.event_id, count(*) FILTER (o.outcome = 'committed') AS c, count(*) FILTER (o.outcome = 'dead_lettered') AS d,
  max(o.attempts) FILTER (o.outcome = 'committed') AS att FROM events e LEFT JOIN o ON o.event_id = e.event_id GROUP BY 1),
s AS (SELECT *, CASE WHEN event_id % 499 = 3 THEN 2 ELSE 1 END AS s, CASE WHEN event_id % 998 = 3 THEN 1 ELSE 0 END AS r FROM i)
SELECT sum(s)::BIGINT AS submitted, count(*) FILTER (c > 0) AS committed, count(*) FILTER (d > 0) AS dead_lettered, sum(r)::BIGINT AS rejected,
  count(*) FILTER (att > 1) AS retried, sum(greatest(s - r - least(c + d, 1), 0))::BIGINT AS lost, count(*) FILTER (c + d > 1) AS counted_twice, 0::BIGINT AS unknown,
  sum(greatest(s - r - least(c + d, 1), 0)) = 0 AND count(*) FILTER (c + d > 1) = 0 AS zero_loss FROM s""")
def loss_accounting(spark, sf):
    o = B.outcomes(spark, sf)
    written = o.where("event_id % 1009 <> 7").unionByName(o.where("event_id % 2003 = 5"))
    again = o.where("event_id % 499 = 3")
    return R.loss_accounting(o.unionByName(again), written, rejected=again.where("event_id % 998 = 3"))


@query("rejected_events", with_ctes("", "outcomes").rstrip() + """,
b AS (SELECT event_id, event_id AS seq FROM outcomes UNION ALL SELECT event_id, event_id + 1000000 FROM outcomes WHERE event_id % 7 = 0)
SELECT event_id, seq, CASE WHEN event_id % 10 = 4 THEN 'already settled' WHEN seq >= 1000000 AND event_id % 7 = 0 AND seq = event_id + 1000000 THEN 'repeated in the batch' END AS reason
FROM b WHERE event_id % 10 = 4 OR seq = event_id + 1000000""")
def rejected_events(spark, sf):
    o = B.outcomes(spark, sf).select("event_id", F.col("event_id").alias("seq"))
    batch = o.unionByName(o.where("event_id % 7 = 0").withColumn("seq", F.col("seq") + 1000000))
    return G.with_reject_reason(batch, o.where("event_id % 10 = 4"), "event_id", ["seq"]).where("reason is not null")


@query("max_dead_run", with_ctes("""
SELECT max(n) AS longest_run FROM (SELECT g, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY outcome ORDER BY event_id) AS g, outcome
  FROM outcomes) WHERE outcome = 'dead_lettered' GROUP BY g)""", "outcomes"))
def max_dead_run(spark, sf):
    return R.longest_run(B.outcomes(spark, sf), "event_id", F.col("outcome") == "dead_lettered")


@query("retry_due", with_ctes("""
SELECT event_id, attempt, CASE WHEN attempt >= 3 THEN 'dead_letter' WHEN next_try <= 1705276800.0 THEN 'due' ELSE 'waiting' END AS state, round(next_try, 3) AS next_try_sec
FROM (SELECT event_id, event_id % 3 + 1 AS attempt, finished_sec + 0.05 * pow(2.0, event_id % 3) AS next_try FROM outcomes WHERE attempts > 1)""", "outcomes"))
def retry_due(spark, sf):
    failed = B.outcomes(spark, sf).where("attempts > 1").select("event_id", (F.col("event_id") % 3 + 1).alias("attempt"), "finished_sec")
    s = retry.with_state(failed, "finished_sec", 1705276800.0)
    return s.select("event_id", "attempt", "state", F.round("next_try_sec", 3).alias("next_try_sec"))


@query("latest_state", with_ctes("""
SELECT resource_id, count(*) AS events, max(timestamp) AS last_timestamp, arg_max(event_id, timestamp || event_id) AS last_event_id FROM decided
WHERE decision <> 'off_chain_only' GROUP BY resource_id""", "decided"))
def latest_state(spark, sf):
    log = B.decided(spark, sf).where("decision <> 'off_chain_only'").select(
        "row_id", "event_id", "timestamp", F.coalesce("cloud_resource_id", F.lit(K.UNMAPPED_RESOURCE)).alias("resource_id"))
    return serving.latest_state(log, "resource_id")


@query("arrival_windows", with_ctes("", "outcomes").rstrip() + """,
a AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, count(*) AS n FROM outcomes GROUP BY 1),
c AS (SELECT time_bucket(INTERVAL 1 hour, ts + to_microseconds(round(latency_ms * 60000)::BIGINT)) AS w, count(*) AS n FROM outcomes WHERE outcome = 'committed' GROUP BY 1),
j AS (SELECT coalesce(a.w, c.w) AS w, coalesce(a.n, 0) AS arrivals, coalesce(c.n, 0) AS commits FROM a FULL JOIN c ON a.w = c.w)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, arrivals, commits, (sum(arrivals - commits) OVER (ORDER BY w))::BIGINT AS backlog FROM j""")
def arrival_windows(spark, sf):
    # commit times lag by latency stretched to minutes, so that windows have a backlog
    o = B.outcomes(spark, sf).withColumn("done", F.timestamp_add("MICROSECOND", F.round(F.col("latency_ms") * 60000).cast("long"), F.col("ts")))
    w = R.arrival_windows(o, "ts", o.where("outcome = 'committed'"), "done")
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_digest", with_ctes("""
SELECT row_id // 1000 AS batch, count(*) AS n, sha256(string_agg(feature_digest, '' ORDER BY row_id)) AS stream_digest FROM alerts GROUP BY 1""", "alerts"))
def stream_digest(spark, sf):
    a = B.alerts(spark, sf).select("row_id", "feature_digest", F.floor(F.col("row_id") / 1000).alias("batch"))
    return R.stream_digest(a, "row_id", "feature_digest", ["batch"])


@query("anchor_summary", with_ctes("""
SELECT pred AS class, count(*) AS processed, count(*) FILTER (score >= 0.6) AS anchored, count(*) FILTER (score < 0.6) AS off_chain,
  round(avg((score >= 0.6)::INT), 6) AS anchored_share, round(avg(score), 6) AS mean_confidence FROM flow GROUP BY pred""", "flow"))
def anchor_summary(spark, sf):
    f = B.flow(spark, sf).withColumn("anchor", F.col("score") >= B.TAU)
    return rounded(R.anchor_summary(f, "pred", "anchor", "score"))


@query("class_profile", with_ctes(
    "SELECT category AS class, count(*) AS support, round(avg(score), 6) AS mean_confidence FROM flow WHERE category <> 'Benign' GROUP BY 1", "flow"))
def class_profile(spark, sf):
    return rounded(C.class_profile(B.flow(spark, sf), "category", "score"))


@query("key_results", with_ctes("""
SELECT unnest(['tp', 'fp', 'fn', 'tn', 'f1']) AS metric, round(unnest([tp::DOUBLE, fp, fn, tn, 2.0 * tp / (2 * tp + fp + fn)]), 6) AS value FROM (SELECT
  count(*) FILTER (category <> 'Benign' AND pred <> 'Benign') AS tp, count(*) FILTER (category = 'Benign' AND pred <> 'Benign') AS fp,
  count(*) FILTER (category <> 'Benign' AND pred = 'Benign') AS fn, count(*) FILTER (category = 'Benign' AND pred = 'Benign') AS tn FROM flow)""", "flow"))
def key_results(spark, sf):
    row = M.binary_metrics(M.confusion(B.flow(spark, sf), "category", "pred"))
    return rounded(R.key_results(row, ["tp", "fp", "fn", "tn", "f1"]))


@query("benchmark_table", with_ctes("""
SELECT 'own rule' AS system, printf('%.4f', round(avg((category = pred)::INT), 6)) AS accuracy, 'not reported' AS f1, 'measured' AS origin FROM flow
UNION ALL SELECT * FROM (VALUES ('Nguyen et al.', '0.9950', '0.9950', 'published'), ('Nguyen et al.', 'not reported', '0.9920', 'published'),
  ('Sarhan et al.', '0.8910', '0.8890', 'published'))""", "flow"))
def benchmark_table(spark, sf):
    own = B.flow(spark, sf).agg(F.round(F.avg((F.col("category") == F.col("pred")).cast("double")), 6).alias("accuracy")).select(
        F.lit("own rule").alias("system"), "accuracy", F.lit(None).cast("double").alias("f1"), F.lit("macro").alias("f1_kind"),
        F.lit("multiclass").alias("classification"), F.lit(False).alias("matched_dataset"))
    return R.benchmark_table(own).select("system", "accuracy", "f1", "origin")
