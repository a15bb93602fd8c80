"""How the supplied tables stand in for flows, alerts and commit logs.

Each binding exists twice: as DataFrame code and as a CTE for the reference SQL. Derived values are
plain integer or IEEE arithmetic, so both sides agree bit for bit. Everything scales with ``events``
or ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import sha256_hex, uuid5
from ..functions.text import rfc3339
from ..operators import evidence
from ..operators.cleaning import verdict
from ..operators.gate import GatePolicy
from ..operators.ledger import assign_batches
from ..sources.tables import spread, table

CLASSES = ["Benign", "Bot", "DDoS", "Infiltration"]
EVENT_MAP = {"view": "Benign", "click": "Benign", "signup": "Bot", "purchase": "DDoS", "error": "Infiltration"}
TAU = 0.6
PRODUCER = "detector"
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "dup_feature", "const_feature"]
LINE_CLASSES = ["A", "N", "R"]
POLICY = GatePolicy(confidence_threshold=0.5, category_thresholds={"Infiltration": 0.3}, immediate_confidence_threshold=0.8)
BATCH = 100

_CATEGORY = (
    "CASE event_type WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'Benign' WHEN 'signup' THEN 'Bot' "
    "WHEN 'purchase' THEN 'DDoS' ELSE 'Infiltration' END"
)

CTES: dict[str, tuple[list[str], str]] = {
    "flow": ([], f"""
        SELECT event_id AS row_id, ts, user_id, event_type AS attack, value,
          CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
          {_CATEGORY} AS category, value / (value + 50.0) AS score,
          CASE WHEN event_id % 10 < 7 THEN {_CATEGORY}
               WHEN event_id % 4 = 0 THEN 'Benign' WHEN event_id % 4 = 1 THEN 'Bot'
               WHEN event_id % 4 = 2 THEN 'DDoS' ELSE 'Infiltration' END AS pred
        FROM events"""),
    "weights": (["flow"], """
        SELECT *, 1 + (row_id * 7) % 31 + CASE WHEN pred = 'Benign' THEN 40 ELSE 0 END AS w0,
          1 + (row_id * 11) % 29 + CASE WHEN pred = 'Bot' THEN 40 ELSE 0 END AS w1,
          1 + (row_id * 13) % 37 + CASE WHEN pred = 'DDoS' THEN 40 ELSE 0 END AS w2,
          1 + (row_id * 17) % 23 + CASE WHEN pred = 'Infiltration' THEN 40 ELSE 0 END AS w3
        FROM flow"""),
    "scored": (["weights"], """
        SELECT *, CAST(w0 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 AS DOUBLE) AS p0,
          CAST(w1 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 AS DOUBLE) AS p1,
          CAST(w2 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 AS DOUBLE) AS p2,
          CAST(w3 AS DOUBLE) / CAST(w0 + w1 + w2 + w3 AS DOUBLE) AS p3
        FROM weights"""),
    "lines": ([], """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
          l_extendedprice * 2.0 AS dup_feature, 1.0::DOUBLE AS const_feature, l_returnflag AS category,
          CASE WHEN l_orderkey % 5 < 3 THEN 'train' WHEN l_orderkey % 5 = 3 THEN 'val' ELSE 'test' END AS split
        FROM lineitem"""),
    "raw_alerts": (["flow"], """
        SELECT row_id, user_id, score, k, value, category AS truth,
          sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('alert/' || row_id)) AS u,
          '1.0.0' AS schema_version, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
          CASE WHEN pred = 'Benign' THEN 'NORMAL' ELSE 'ANOMALY' END AS verdict, pred AS threat_class,
          CASE pred WHEN 'Benign' THEN 'NONE' WHEN 'Infiltration' THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
          round(score, 6) AS confidence, 'detector-' || (row_id % 6) AS model_version,
          CASE WHEN row_id % 17 = 0 THEN NULL ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src_ip,
          CASE WHEN row_id % 5 = 0 THEN NULL ELSE 1024 + row_id % 5000 END AS src_port,
          CASE WHEN row_id % 19 = 0 THEN NULL ELSE '172.16.' || (user_id % 7) || '.' || (user_id % 251) END AS dst_ip,
          CASE WHEN row_id % 3 = 0 THEN 443 ELSE 80 END AS dst_port,
          score >= 0.6 AS anchor, round((row_id % 50) / 10.0 + 0.5, 4) AS inference_latency_ms,
          sha256('k=' || printf('%.6f', k) || '|value=' || printf('%.6f', round(value, 6))) AS feature_digest
        FROM flow"""),
    "unhashed": (["raw_alerts"], """
        SELECT *, substr(u,1,8) || '-' || substr(u,9,4) || '-5' || substr(u,14,3) || '-' ||
            translate(substr(u,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(u,18,3) || '-' || substr(u,21,12) AS event_id,
          'cloud-res-' || substr(sha256(dst_ip), 1, 12) AS cloud_resource_id,
          sha256(model_version) AS model_digest, 'agent-' || user_id AS agent_id
        FROM raw_alerts"""),
    "alerts": (["unhashed"], """
        SELECT *, sha256(canonical) AS event_hash FROM (SELECT *,
          'event_id=' || event_id || '|schema_version=' || schema_version || '|timestamp=' || timestamp ||
          '|verdict=' || verdict || '|threat_class=' || threat_class || '|confidence=' || printf('%.6f', confidence) ||
          '|model_version=' || model_version || '|src_ip=' || coalesce(src_ip, chr(0)) ||
          '|src_port=' || coalesce(CAST(src_port AS VARCHAR), chr(0)) || '|dst_ip=' || coalesce(dst_ip, chr(0)) ||
          '|dst_port=' || dst_port || '|cloud_resource_id=' || coalesce(cloud_resource_id, chr(0)) ||
          '|feature_digest=' || feature_digest AS canonical FROM unhashed)"""),
    # canonical JSON of the evidence event: members in key order, optional ones left out
    "evidence": (["alerts"], """
        SELECT *, sha256('{' || body || '}') AS payload_digest,
          replace(replace('{' || replace(body, ',"resource_id"', ',"payload_digest":"' || sha256('{' || body || '}') || '","resource_id"') || '}', ',"', ', "'), '":', '": ') AS payload
        FROM (SELECT *,
          CASE WHEN threat_class = 'Benign' THEN 'BENIGN' ELSE 'ATTACK' END AS event_verdict,
          coalesce(cloud_resource_id, 'unmapped-resource') AS resource_id,
          CASE severity WHEN 'NONE' THEN 'informational' ELSE lower(severity) END AS event_severity,
          '"calibrated_confidence":' || CAST(confidence AS VARCHAR) ||
          ',"calibration":{"is_calibrated":true,"method":"isotonic"},"contract_version":"2.0.0","destination_address":' ||
          coalesce('"' || dst_ip || ':' || dst_port || '"', 'null') ||
          ',"detection_contract":{"anchor_gate_tau":0.6,"digest_verified_by_consumer":true,"event_hash":"' || event_hash ||
          '","feature_digest":"' || feature_digest || '","producer":"detector","producer_anchor_decision":' || anchor ||
          ',"schema_version":"1.0.0"},"event_id":"' || event_id || '","feature_attributions":[],"inference_latency_ms":' ||
          CAST(inference_latency_ms AS VARCHAR) || ',"model":{"model_digest":"' || model_digest || '","model_id":"' || model_version ||
          '","version_label":"' || model_version || '"},"resource_id":"' || coalesce(cloud_resource_id, 'unmapped-resource') ||
          '","severity":"' || CASE severity WHEN 'NONE' THEN 'informational' ELSE lower(severity) END ||
          '","source_address":' || CASE WHEN src_ip IS NULL THEN 'null' WHEN src_port IS NULL THEN '"' || src_ip || '"'
             ELSE '"' || src_ip || ':' || src_port || '"' END ||
          ',"threat_category":"' || threat_class || '","timestamp":"' || timestamp || '","triggering_features":{"k":' ||
          CAST(k AS VARCHAR) || ',"value":' || CAST(round(value, 6) AS VARCHAR) || '},"verdict":"' ||
          CASE WHEN threat_class = 'Benign' THEN 'BENIGN' ELSE 'ATTACK' END || '"' AS body
        FROM alerts)"""),
    "decided": (["evidence"], """
        SELECT *, CASE WHEN event_verdict <> 'ATTACK' THEN 'off_chain_only'
          WHEN confidence < CASE WHEN threat_class = 'Infiltration' THEN 0.3 ELSE 0.5 END THEN 'off_chain_only'
          WHEN confidence >= 0.8 THEN 'immediate' ELSE 'batch' END AS decision
        FROM evidence"""),
    "registry": ([], "SELECT 'agent-' || s_suppkey AS agent_id, sha256(s_name) AS key_hex FROM supplier"),
    "provenance": ([], "SELECT sha256('detector-' || r_regionkey) AS model_digest FROM region"),
    # seven chains, batches by arrival order within each
    "batched": (["decided"], """
        SELECT *, (pos - 1) // 100 AS batch_no, (pos - 1) % 100 AS leaf_index FROM (
          SELECT *, 'chain-' || (user_id % 7) AS chain,
            row_number() OVER (PARTITION BY 'chain-' || (user_id % 7) ORDER BY row_id) AS pos
          FROM decided WHERE decision <> 'off_chain_only')"""),
    "roots": (["batched"], """
        SELECT chain, batch_no, n AS record_count, h AS merkle_root FROM (
          WITH RECURSIVE lv AS (
            SELECT chain, batch_no, 0 AS depth, leaf_index AS i, payload_digest AS h,
              count(*) OVER (PARTITION BY chain, batch_no) AS width, count(*) OVER (PARTITION BY chain, batch_no) AS n
            FROM batched
            UNION ALL
            SELECT chain, batch_no, depth + 1, i // 2,
              sha256(unhex(h) || unhex(coalesce(nxt, h))), (width + 1) // 2, n
            FROM (SELECT *, lead(h) OVER (PARTITION BY chain, batch_no, depth ORDER BY i) AS nxt FROM lv WHERE width > 1)
            WHERE i % 2 = 0)
          SELECT * FROM lv WHERE width = 1)"""),
    "blocks": (["roots"], """
        WITH RECURSIVE link AS (
          SELECT chain, batch_no AS block_number, merkle_root, record_count, repeat('0', 64) AS previous_hash,
            sha256('{"chain":"' || chain || '","index":0,"merkle_root":"' || merkle_root || '","previous_hash":"' ||
              repeat('0', 64) || '","record_count":' || record_count || '}') AS hash
          FROM roots WHERE batch_no = 0
          UNION ALL
          SELECT r.chain, r.batch_no, r.merkle_root, r.record_count, l.hash,
            sha256('{"chain":"' || r.chain || '","index":' || r.batch_no || ',"merkle_root":"' || r.merkle_root ||
              '","previous_hash":"' || l.hash || '","record_count":' || r.record_count || '}')
          FROM link l JOIN roots r ON r.chain = l.chain AND r.batch_no = l.block_number + 1)
        SELECT * FROM link"""),
    "outcomes": (["flow"], """
        SELECT *, enqueued_sec + latency_ms / 1000.0 AS finished_sec FROM (SELECT row_id AS event_id, user_id, ts,
          CASE WHEN row_id % 97 < (row_id // 97) % 4 THEN 'dead_lettered' ELSE 'committed' END AS outcome,
          CASE WHEN row_id % 97 < (row_id // 97) % 4 THEN 3 WHEN row_id % 11 = 0 THEN 2 ELSE 1 END AS attempts,
          epoch_us(ts) / 1000000.0 AS enqueued_sec,
          value * CASE WHEN row_id % 97 < (row_id // 97) % 4 THEN 3 WHEN row_id % 11 = 0 THEN 2 ELSE 1 END AS latency_ms
        FROM flow)"""),
}


def with_ctes(body: str, *names: str) -> str:
    """Reference SQL with the named bindings and everything they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    heads = ", ".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {heads} {body}" if heads else body


# --- the same bindings as DataFrames -----------------------------------------------------------
def _category(event_type: Column) -> Column:
    out = F.lit("Infiltration")
    for name in ("purchase", "signup", "click", "view"):
        out = F.when(event_type == name, EVENT_MAP[name]).otherwise(out)
    return out


def flow(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """Flow view of ``events``; ``heavy`` says that much work per row follows."""
    e = table(spark, sf, "events")
    e = spread(e) if heavy else e
    own = _category(F.col("event_type"))
    other = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("row_id"), "ts", "user_id", F.col("event_type").alias("attack"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"), own.alias("category"),
        (F.col("value") / (F.col("value") + 50.0)).alias("score"),
        F.when(F.col("event_id") % 10 < 7, own).otherwise(other).alias("pred"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with a probability per class, as columns p0..p3 and array ``prob``."""
    out = flow(spark, sf)
    for i, (factor, modulus) in enumerate(((7, 31), (11, 29), (13, 37), (17, 23))):
        bonus = F.when(F.col("pred") == CLASSES[i], 40).otherwise(0)
        out = out.withColumn(f"w{i}", F.lit(1) + (F.col("row_id") * factor) % modulus + bonus)
    total = (F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3")).cast("double")
    out = out.withColumns({f"p{i}": F.col(f"w{i}").cast("double") / total for i in range(4)})
    return out.withColumn("prob", F.array("p0", "p1", "p2", "p3"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Wide numeric table with a constant and a perfectly correlated column, split by order."""
    l = spread(table(spark, sf, "lineitem"))
    part = F.col("l_orderkey") % 5
    return l.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * 2.0).alias("dup_feature"), F.lit(1.0).alias("const_feature"),
        F.col("l_returnflag").alias("category"),
        F.when(part < 3, "train").when(part == 3, "val").otherwise("test").alias("split"),
    )


def scored_for_alerts(spark: SparkSession, sf: str) -> DataFrame:
    f = flow(spark, sf, heavy=True)
    user, row = F.col("user_id"), F.col("row_id")
    octets = lambda prefix, a, b: F.concat(F.lit(prefix), a.cast("string"), F.lit("."), b.cast("string"))
    return f.select(
        "row_id", "user_id", "ts", "score", "k", "value", "category", F.col("pred").alias("threat_class"),
        F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k")).alias("features"),
        F.when(row % 17 != 0, octets("10.0.", F.floor(user / 256), user % 256)).alias("src_ip"),
        F.when(row % 5 != 0, 1024 + row % 5000).alias("src_port"),
        F.when(row % 19 != 0, octets("172.16.", user % 7, user % 251)).alias("dst_ip"),
        F.when(row % 3 == 0, 443).otherwise(80).alias("dst_port"),
    )


def alerts(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Producer alerts of every event (plus ``row_id`` and ``user_id`` for ordering and joins)."""
    base = scored_for_alerts(spark, sf)
    row = F.col("row_id")
    latency = (row % 50) / 10.0 + 0.5
    keep = ["row_id", "user_id", *extra]
    built = evidence.build_alerts(
        base.withColumn("_keep", F.struct(*keep)), TAU, F.concat(F.lit("detector-"), (row % 6).cast("string")),
        uuid5(F.concat(F.lit("alert/"), row.cast("string"))), rfc3339(F.col("ts")),
        confidence="score", latency_ms=latency, carry=["_keep"],
    )
    return built.select("*", *[F.col(f"_keep.{c}").alias(c) for c in keep]).drop("_keep")


def evidence_events(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts with struct ``event``, plus agent and chain keys."""
    a = alerts(spark, sf)
    version = F.col("model_version")
    built = evidence.build_events(a, version, sha256_hex(version), PRODUCER)
    return built.withColumns({
        "agent_id": F.concat(F.lit("agent-"), F.col("user_id").cast("string")),
        "chain": F.concat(F.lit("chain-"), (F.col("user_id") % 7).cast("string")),
    })


def decided(spark: SparkSession, sf: str) -> DataFrame:
    # decided on the flat columns: a filter on a struct member would drag the struct along
    category = F.col("threat_class")
    return evidence_events(spark, sf).withColumn(
        "decision", POLICY.decide(verdict(category, "ATTACK", "BENIGN"), category, F.col("confidence"))
    )


def batched(spark: SparkSession, sf: str) -> DataFrame:
    """Anchored events with their Merkle batch; only the columns batching needs."""
    anchored = decided(spark, sf).where(F.col("decision") != "off_chain_only").select(
        "row_id", "chain", "event_id", F.col("event.payload_digest").alias("payload_digest")
    )
    return assign_batches(anchored, "row_id", ["chain"], BATCH)


def registry(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("agent-"), F.col("s_suppkey").cast("string")).alias("agent_id"), sha256_hex(F.col("s_name")).alias("key_hex")
    )


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    return r.select(sha256_hex(F.concat(F.lit("detector-"), F.col("r_regionkey").cast("string"))).alias("model_digest"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), ts)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    f = flow(spark, sf)
    row = F.col("row_id")
    dead = row % 97 < F.floor(row / 97) % 4
    attempts = F.when(dead, 3).when(row % 11 == 0, 2).otherwise(1)
    started = micros(F.col("ts")) / 1000000.0
    out = f.select(
        row.alias("event_id"), "user_id", "ts", F.when(dead, "dead_lettered").otherwise("committed").alias("outcome"),
        attempts.alias("attempts"), started.alias("enqueued_sec"), (F.col("value") * attempts).alias("latency_ms"),
    )
    return out.withColumn("finished_sec", F.col("enqueued_sec") + F.col("latency_ms") / 1000.0)


