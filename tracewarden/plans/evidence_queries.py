"""Digests, contract checks and the payload store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COMMITTED_FIELDS
from ..functions.canonical import with_canonical_json
from ..functions.digests import alert_canonical_string, feature_text
from ..functions.vectors import top_by_magnitude
from ..operators import evidence as E
from ..operators.distributed import pin
from ..sources import store
from . import bindings as B
from .bindings import CLASSES, with_ctes
from .catalog import query

_FEATURES = "'k=' || printf('%.6f', k) || '|value=' || printf('%.6f', round(value, 6))"


@query("canonical_string", with_ctes("SELECT event_id, canonical FROM alerts", "alerts"))
def canonical_strings(spark, sf):
    return B.alerts(spark, sf).select("event_id", alert_canonical_string().alias("canonical"))


@query("event_hash", with_ctes("SELECT event_id, event_hash FROM alerts", "alerts"))
def event_hashes(spark, sf):
    return B.alerts(spark, sf).select("event_id", "event_hash")


@query("feature_digest", with_ctes(f"SELECT event_id, {_FEATURES} AS feature_text, feature_digest FROM alerts", "alerts"))
def feature_digests(spark, sf):
    return B.alerts(spark, sf).select("event_id", feature_text(F.col("features")).alias("feature_text"), "feature_digest")


@query("canonical_json", with_ctes("""
SELECT event_id, '{"dst":{"ip":' || coalesce('"' || dst_ip || '"', 'null') || ',"port":' || dst_port || '},"event_id":"' || event_id ||
  '","note":"user\\t\\"' || user_id || '\\"","severity":"' || severity || '"}' AS canonical FROM alerts""", "alerts"))
def canonical_json(spark, sf):
    note = F.concat(F.lit('user\t"'), F.col("user_id").cast("string"), F.lit('"'))
    doc = F.struct("severity", note.alias("note"), "event_id", F.struct(F.col("dst_port").alias("port"), F.col("dst_ip").alias("ip")).alias("dst"))
    return with_canonical_json(B.alerts(spark, sf).withColumn("doc", doc), "doc", "canonical").select("event_id", "canonical")


@query("payload_digest", with_ctes("SELECT event_id, payload_digest FROM evidence", "evidence"))
def payload_digests(spark, sf):
    return B.evidence_events(spark, sf).select("event_id", F.col("event.payload_digest").alias("payload_digest"))


@query("onchain_projection", with_ctes(f"SELECT {', '.join(COMMITTED_FIELDS)} FROM alerts", "alerts"))
def onchain_projection(spark, sf):
    return E.committed_projection(B.alerts(spark, sf))


@query("offchain_projection", with_ctes(
    f"SELECT event_id, {_FEATURES} AS features, src_ip, src_port, dst_ip, dst_port::BIGINT AS dst_port FROM alerts", "alerts"))
def offchain_projection(spark, sf):
    p = E.offchain_projection(B.alerts(spark, sf))
    return p.withColumn("features", feature_text(F.col("features"))).drop("top_contributing_features")


@query("evidence_event", with_ctes("""
SELECT event_id, timestamp, event_verdict AS verdict, threat_class AS threat_category, event_severity AS severity,
  confidence AS calibrated_confidence, true AS is_calibrated, 'isotonic' AS method,
  CASE WHEN src_ip IS NULL THEN NULL WHEN src_port IS NULL THEN src_ip ELSE src_ip || ':' || src_port END AS source_address,
  dst_ip || ':' || dst_port AS destination_address, resource_id, model_version AS model_id, model_digest, event_hash, anchor AS producer_anchor_decision,
  inference_latency_ms::DOUBLE AS inference_latency_ms FROM evidence""", "evidence"))
def evidence_event(spark, sf):
    return B.evidence_events(spark, sf).select("event.*").select(
        "event_id", "timestamp", "verdict", "threat_category", "severity", "calibrated_confidence", "calibration.is_calibrated",
        "calibration.method", "source_address", "destination_address", "resource_id", "model.model_id", "model.model_digest",
        "detection_contract.event_hash", "detection_contract.producer_anchor_decision", "inference_latency_ms")


def _damaged(spark, sf):
    a, row = B.alerts(spark, sf), F.col("row_id")
    return a.withColumns({
        "confidence": F.when(row % 13 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")),
        "threat_class": F.when(row % 29 == 0, "Spoof").otherwise(F.col("threat_class")),
        "features": F.when(row % 31 == 0, F.create_map(F.lit("k"), F.lit(-1.0))).otherwise(F.col("features")),
        "timestamp": F.when(row % 37 == 0, "2024/01/01").otherwise(F.col("timestamp")),
        "severity": F.when(row % 41 != 0, F.col("severity")),
        "src_port": F.when(row % 43 == 0, 70000).otherwise(F.col("src_port")),
    })


_CODES = """concat_ws('|', CASE WHEN row_id % 41 = 0 THEN 'missing:severity' END, CASE WHEN row_id % 37 = 0 THEN 'format:timestamp' END,
  CASE WHEN row_id % 29 = 0 THEN 'enum:threat_class' END, CASE WHEN row_id % 13 = 0 THEN 'range:confidence' END,
  CASE WHEN row_id % 43 = 0 THEN 'range:src_port' END, CASE WHEN row_id % 31 = 0 THEN 'digest:features' END,
  CASE WHEN row_id % 13 = 0 OR row_id % 29 = 0 OR row_id % 37 = 0 OR row_id % 43 = 0 THEN 'digest:event' END,
  CASE WHEN row_id % 29 = 0 AND verdict = 'NORMAL' THEN 'consistency:verdict' END)"""


@query("contract_violations", with_ctes(f"SELECT event_id, {_CODES} AS violations FROM alerts", "alerts"))
def contract_violations(spark, sf):
    return _damaged(spark, sf).select("event_id", F.array_join(E.alert_violations(["k", "value"]), "|").alias("violations"))


@query("contract_rejects", with_ctes(f"""
SELECT code, count(*) AS n FROM (SELECT unnest(string_split({_CODES}, '|')) AS code FROM alerts) WHERE code <> '' GROUP BY code""", "alerts"))
def contract_rejects(spark, sf):
    _, rejects = E.split_valid(_damaged(spark, sf), E.alert_violations(["k", "value"]))
    return rejects.select(F.explode("violations").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("event_contract", with_ctes("""
SELECT event_id, CASE WHEN row_id % 23 = 0 THEN 'missing:severity' WHEN row_id % 47 = 0 THEN 'enum:severity' ELSE '' END AS violations FROM alerts""", "alerts"))
def event_contract(spark, sf):
    e, row = B.evidence_events(spark, sf), F.col("row_id")
    damaged = F.when(row % 23 == 0, F.lit(None)).when(row % 47 == 0, "HIGH").otherwise(F.col("event.severity"))
    e = e.withColumn("event", F.col("event").withField("severity", damaged))
    return e.select("event_id", F.array_join(E.event_violations(), "|").alias("violations"))


@query("topk_attributions", with_ctes("""
SELECT row_id, rank, feature, round(shap, 6) AS shap FROM (
  SELECT row_id, feature, shap, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, i) - 1 AS rank FROM (
    SELECT row_id, unnest(['Benign', 'Bot', 'DDoS', 'Infiltration']) AS feature, unnest([p0 - 0.25, p1 - 0.25, p2 - 0.25, p3 - 0.25]) AS shap,
      unnest([0, 1, 2, 3]) AS i FROM scored)) WHERE rank < 5""", "scored"))
def topk_attributions(spark, sf):
    items = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"p{i}").alias("value"), (F.col(f"p{i}") - 0.25).alias("shap")) for i, c in enumerate(CLASSES)])
    top = B.scored(spark, sf).select("row_id", F.posexplode(top_by_magnitude(items, "shap", 5)).alias("rank", "a"))
    return top.select("row_id", F.col("rank").cast("long").alias("rank"), F.col("a.feature").alias("feature"), F.round("a.shap", 6).alias("shap"))


def stored_payloads(spark, sf):
    """Events with payload text and address. These two are pinned, since here the store is computed and not a table;
    filters on rows still reach the scan, and members that nobody reads are not built."""
    p = E.with_stored_payload(B.evidence_events(spark, sf))
    return pin(p.select("row_id", "event", "payload", "size_bytes", *COMMITTED_FIELDS, "content_address"), ["payload", "content_address"])


@query("evidence_put", with_ctes("""
SELECT DISTINCT 'sha256:' || sha256(payload) AS content_address, octet_length(encode(payload)) AS size_bytes FROM evidence WHERE row_id % 3 <> 0""", "evidence"))
def evidence_put(spark, sf):
    p = stored_payloads(spark, sf)
    held = store.as_stored(p.where("row_id % 3 = 0"))
    twice = p.select(F.explode(F.array("payload", "payload")).alias("payload"))  # a union would build every payload twice
    return store.new_payloads(twice, held).select("content_address", "size_bytes")


@query("evidence_exists", with_ctes("SELECT event_id, row_id % 3 = 0 AND row_id % 7 <> 0 AS exists FROM evidence", "evidence"))
def evidence_exists(spark, sf):
    p = stored_payloads(spark, sf)
    held = store.as_stored(p.where("row_id % 3 = 0"))
    asked = F.when(F.col("row_id") % 7 == 0, F.substring("content_address", 1, 30)).otherwise(F.col("content_address"))
    requests = p.select("event_id", asked.alias("content_address"))
    return store.exists(requests, held).select("event_id", "exists")


@query("evidence_get", with_ctes("SELECT event_id, CASE WHEN row_id % 3 = 0 THEN sha256(payload) END AS fetched FROM evidence", "evidence"))
def evidence_get(spark, sf):
    p = stored_payloads(spark, sf)
    held = store.as_stored(p.where("row_id % 3 = 0"))
    return store.get(p.select("event_id", "content_address"), held).select("event_id", F.sha2("payload", 256).alias("fetched"))
