"""Batches, Merkle trees, hash links, log queries and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.merkle import merkle_verify
from ..operators import audit as A
from ..operators import evidence as E
from ..operators import ledger as G
from ..operators.distributed import pin
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .evidence_queries import stored_payloads


@query("batch_assign", with_ctes("SELECT event_id, chain, batch_no, leaf_index FROM batched", "batched"))
def batch_assign(spark, sf):
    return B.batched(spark, sf).select("event_id", "chain", "batch_no", "leaf_index")


@query("merkle_root", with_ctes("SELECT chain, batch_no, record_count, merkle_root FROM roots", "roots"))
def merkle_root(spark, sf):
    return G.batch_roots(B.batched(spark, sf), "payload_digest", ["chain"])


_PROOF = """lv AS (
  SELECT chain, batch_no, 0 AS depth, leaf_index AS i, payload_digest AS h, count(*) OVER (PARTITION BY chain, batch_no) AS width FROM batched
  UNION ALL
  SELECT chain, batch_no, depth + 1, i // 2, sha256(unhex(h) || unhex(coalesce(nxt, h))), (width + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY chain, batch_no, depth ORDER BY i) AS nxt FROM lv WHERE width > 1) WHERE i % 2 = 0),
steps AS (SELECT b.chain, b.batch_no, b.leaf_index, b.payload_digest AS leaf, own.depth,
    CASE WHEN own.i % 2 = 0 THEN 'R' ELSE 'L' END AS direction, coalesce(sib.h, own.h) AS sibling
  FROM batched b JOIN lv own ON own.chain = b.chain AND own.batch_no = b.batch_no AND own.i = b.leaf_index // (1 << own.depth) AND own.width > 1
  LEFT JOIN lv sib ON sib.chain = own.chain AND sib.batch_no = own.batch_no AND sib.depth = own.depth AND sib.i = xor(own.i, 1::BIGINT))"""


@query("merkle_proof", with_ctes("", "roots").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_PROOF}
SELECT b.chain, b.batch_no, b.leaf_index, b.payload_digest AS leaf, r.merkle_root,
  coalesce(string_agg(direction || ':' || sibling, '|' ORDER BY depth), '') AS proof
FROM batched b JOIN roots r USING (chain, batch_no) LEFT JOIN steps s USING (chain, batch_no, leaf_index) GROUP BY ALL""")
def merkle_proof(spark, sf):
    p = _proofs(spark, sf)
    text = F.array_join(F.transform("proof", lambda s: F.concat(s["direction"], F.lit(":"), s["sibling"])), "|")
    return p.withColumn("proof", text)


def _proofs(spark, sf):
    return G.batch_proofs(B.batched(spark, sf), "payload_digest", ["chain"])


@query("merkle_verify", with_ctes("SELECT chain, batch_no, leaf_index, leaf_index % 5 <> 0 AS included FROM batched", "batched"))
def merkle_verifies(spark, sf):
    wrong = F.sha2("leaf", 256)
    claimed = F.when(F.col("leaf_index") % 5 == 0, wrong).otherwise(F.col("leaf"))
    return _proofs(spark, sf).select(
        "chain", "batch_no", "leaf_index", merkle_verify(claimed, F.col("proof"), F.col("merkle_root")).alias("included"))


def linked(spark, sf):
    roots = G.batch_roots(B.batched(spark, sf), "payload_digest", ["chain"]).withColumnRenamed("batch_no", "block_number")
    return G.link_blocks(roots, "chain")


@query("chain_append", with_ctes("SELECT chain, block_number, merkle_root, record_count, previous_hash, hash FROM blocks", "blocks"))
def chain_append(spark, sf):
    return linked(spark, sf).drop("segment")


# every chain has block 1 altered; the last block's hash is altered in chain-3
@query("chain_verify", with_ctes("""
SELECT chain, count(*) AS blocks, count(*) FILTER (block_number = 1 OR (chain = 'chain-3' AND block_number = last)) AS bad_hashes,
  0::BIGINT AS bad_links, count(*) FILTER (block_number = 1 OR (chain = 'chain-3' AND block_number = last)) = 0 AS intact
FROM (SELECT *, max(block_number) OVER (PARTITION BY chain) AS last FROM blocks) GROUP BY chain""", "blocks"))
def chain_verify(spark, sf):
    blocks = linked(spark, sf)
    ends = G.chain_heads(blocks, "chain").select("chain", (F.col("next_block") - 1).alias("last"))
    altered = blocks.join(ends, "chain").withColumns({
        "merkle_root": F.when(F.col("block_number") == 1, F.sha2(F.lit("altered"), 256)).otherwise(F.col("merkle_root")),
        "hash": F.when((F.col("chain") == "chain-3") & (F.col("block_number") == F.col("last")), F.sha2("hash", 256)).otherwise(F.col("hash")),
    }).drop("last")
    return G.chain_status(G.verify_chain(altered, "chain"), "chain")


def records(spark, sf):
    """Committed records of the anchored events, signed by their agents."""
    p = E.with_stored_payload(B.decided(spark, sf).where("decision <> 'off_chain_only'"))
    p = pin(p.select("row_id", "agent_id", "event", "content_address"))
    rec = E.committed_records(p, F.col("agent_id"), F.lit(None).cast("string"), carry=["row_id"])
    return A.sign(rec.drop("signature"), B.registry(spark, sf))


_LOG = "log AS (SELECT event_id, row_id, payload_digest, resource_id, threat_class AS threat_category, confidence, timestamp, agent_id, model_digest FROM decided WHERE decision <> 'off_chain_only')"


def _log(spark, sf):
    d = B.decided(spark, sf).where("decision <> 'off_chain_only'")
    e = F.col("event")
    return d.select(
        "event_id", "row_id", e["payload_digest"].alias("payload_digest"), e["resource_id"].alias("resource_id"),
        e["threat_category"].alias("threat_category"), e["calibrated_confidence"].alias("confidence"), e["timestamp"].alias("timestamp"),
        "agent_id", e["model"]["model_digest"].alias("model_digest"))


@query("event_history", with_ctes("", "decided").rstrip() + f""", {_LOG} SELECT event_id, resource_id, timestamp FROM log
WHERE timestamp >= '2024-01-05T00:00:00.000Z' AND timestamp <= '2024-01-20T00:00:00.000Z' AND threat_category = 'Infiltration'""")
def event_history(spark, sf):
    picked = G.event_history(_log(spark, sf), "timestamp", F.col("threat_category") == "Infiltration",
                             F.lit("2024-01-05T00:00:00.000Z"), F.lit("2024-01-20T00:00:00.000Z"))
    return picked.select("event_id", "resource_id", "timestamp").orderBy("timestamp", "event_id")


@query("verify_events", with_ctes("", "decided").rstrip() + f""", {_LOG}
SELECT d.event_id, l.event_id IS NOT NULL AND d.row_id % 9 <> 0 AS verified FROM decided d LEFT JOIN log l USING (event_id)""")
def verify_events(spark, sf):
    d = B.evidence_events(spark, sf)
    own = F.col("event.payload_digest")
    requests = d.select("event_id", F.when(F.col("row_id") % 9 == 0, F.sha2(own, 256)).otherwise(own).alias("payload_digest"))
    return G.verify_events(requests, _log(spark, sf)).select("event_id", "verified")


@query("append_new", with_ctes("", "decided").rstrip() + f""", {_LOG}
SELECT event_id, payload_digest FROM log WHERE row_id % 4 <> 0""")
def append_new(spark, sf):
    log = _log(spark, sf)
    held = log.where("row_id % 4 = 0")
    again = log.withColumns({"row_id": F.col("row_id") + 1_000_000_000, "payload_digest": F.sha2("payload_digest", 256)})
    return G.append_new(log.unionByName(again), held, "event_id", "row_id").select("event_id", "payload_digest")


@query("duplicate_ids", with_ctes("SELECT event_id, 2::BIGINT AS n FROM decided WHERE row_id % 5 = 0", "decided"))
def duplicate_ids(spark, sf):
    ids = B.alerts(spark, sf).select("event_id", "row_id")
    return G.duplicate_ids(ids.union(ids.where("row_id % 5 = 0")), "event_id")


@query("unauthorised_writes", with_ctes("", "decided", "registry").rstrip() + f""", {_LOG}
SELECT event_id, agent_id FROM log WHERE agent_id NOT IN (SELECT agent_id FROM registry)""")
def unauthorised_writes(spark, sf):
    return G.unauthorised_writes(_log(spark, sf), B.registry(spark, sf)).select("event_id", "agent_id")


@query("provenance_trace", with_ctes("", "decided", "provenance").rstrip() + f""", {_LOG}
SELECT event_id, model_digest, model_digest IN (SELECT model_digest FROM provenance) AS provenance_found FROM log""")
def provenance_trace(spark, sf):
    return A.provenance_trace(_log(spark, sf).select("event_id", "model_digest"), B.provenance(spark, sf))


@query("handoff_map", with_ctes("SELECT event_id, event_hash AS source_digest, payload_digest AS target_digest FROM evidence", "evidence"))
def handoff_map(spark, sf):
    a = B.alerts(spark, sf).select("event_id", F.col("event_hash").alias("digest"))
    e = B.evidence_events(spark, sf).select("event_id", F.col("event.payload_digest").alias("digest"))
    return G.handoff_map(a, e)


@query("handoff_diff", with_ctes("""
SELECT event_id, CASE WHEN row_id % 10 = 1 THEN NULL ELSE event_hash END AS source_digest,
  CASE WHEN row_id % 10 = 2 THEN NULL WHEN row_id % 10 = 3 THEN sha256(event_hash) ELSE event_hash END AS target_digest,
  CASE row_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'altered' END AS change FROM alerts WHERE row_id % 10 IN (1, 2, 3)""", "alerts"))
def handoff_diff(spark, sf):
    a = B.alerts(spark, sf).select("event_id", "row_id", F.col("event_hash").alias("digest"))
    source = a.where("row_id % 10 <> 1")
    target = a.where("row_id % 10 <> 2").withColumn(
        "digest", F.when(F.col("row_id") % 10 == 3, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return G.handoff_diff(source, target)


# damage: payload missing (53), payload edited (59), committed digest replaced (61), signature replaced (71)
_AUDIT = f"""{_LOG},
ck AS (SELECT *, row_id % 53 <> 0 AS found, row_id % 59 <> 0 AS p_ok, row_id % 61 <> 0 AS l_ok,
  agent_id IN (SELECT agent_id FROM registry) AND row_id % 71 <> 0 AND row_id % 61 <> 0 AS s_ok,
  model_digest IN (SELECT model_digest FROM provenance) AS prov FROM log),
findings AS (SELECT event_id, resource_id, found AND p_ok AS payload_ok, found AND l_ok AS ledger_ok, found AND s_ok AS signature_ok,
  found AND prov AS model_provenance_found, CASE WHEN NOT found THEN 'INCOMPLETE' WHEN p_ok AND l_ok AND s_ok THEN 'VERIFIED' ELSE 'TAMPERED' END AS verdict,
  CASE WHEN NOT found THEN 'payload unavailable' WHEN p_ok AND l_ok AND s_ok THEN 'all checks passed' ELSE
    concat_ws('; ', CASE WHEN NOT p_ok THEN 'payload does not match its own digest' END, CASE WHEN NOT l_ok THEN 'committed digest differs from the payload' END,
      CASE WHEN NOT s_ok THEN 'signature does not verify' END) END AS detail FROM ck)"""


def findings(spark, sf):
    row = F.col("row_id")
    rec = records(spark, sf).withColumns({
        "payload_digest": F.when(row % 61 == 0, F.sha2("payload_digest", 256)).otherwise(F.col("payload_digest")),
        "signature": F.when(row % 71 == 0, F.sha2("signature", 256)).otherwise(F.col("signature")),
    })
    p = stored_payloads(spark, sf).where(row % 53 != 0).select(
        "content_address", "event", F.col("event.payload_digest").alias("claimed_digest"), "row_id")
    edited = F.when(row % 59 == 0, "edited").otherwise(F.col("event.resource_id"))
    p = p.withColumn("event", F.col("event").withField("resource_id", edited))
    payloads = E.with_recomputed_digest(p).select("content_address", "claimed_digest", "recomputed_digest")
    return A.audit(rec, payloads, B.registry(spark, sf), B.provenance(spark, sf))


@query("audit", with_ctes("", "decided", "registry", "provenance").rstrip() + f""", {_AUDIT} SELECT * EXCLUDE resource_id FROM findings""")
def audit(spark, sf):
    return findings(spark, sf).select(
        "event_id", "payload_ok", "ledger_ok", "signature_ok", "model_provenance_found", "verdict", "detail")


@query("compliance_report", with_ctes("", "decided", "registry", "provenance").rstrip() + f""", {_AUDIT}
SELECT resource_id, count(*) AS total_events, count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict = 'TAMPERED') AS tampered,
  count(*) FILTER (verdict = 'INCOMPLETE') AS incomplete, count(*) FILTER (verdict <> 'VERIFIED') = 0 AS unbroken FROM findings GROUP BY ROLLUP (resource_id)""")
def compliance_report(spark, sf):
    return A.compliance_report(findings(spark, sf))


def _pad_sql(high: str, low: str) -> str:
    """Hex of a key xor a pad byte, nibble by nibble."""
    nibbles = "'0123456789abcdef'"
    return (f"array_to_string([translate(substr(key_hex, 2 * i - 1, 1), {nibbles}, '{high}') || translate(substr(key_hex, 2 * i, 1), {nibbles}, '{low}') "
            "FOR i IN range(1, 33)], '')")


# nibbles xor 3 and 6, and xor 5 and c
_PADS = f"""pads AS (SELECT agent_id, {_pad_sql('32107654ba98fedc', '67452301efcdab89')} AS inner_pad,
  {_pad_sql('54761032dcfe98ba', 'cdef89ab45670123')} AS outer_pad FROM registry)"""


@query("hmac_sign", with_ctes("", "decided", "registry").rstrip() + f""", {_LOG}, {_PADS}
SELECT l.event_id, l.agent_id, sha256(unhex(outer_pad || repeat('5c', 32))
  || unhex(sha256(unhex(inner_pad || repeat('36', 32)) || encode(l.payload_digest)))) AS signature
FROM log l LEFT JOIN pads USING (agent_id)""")
def hmac_sign(spark, sf):
    """Keyed digests of the anchored events."""
    return A.sign(_log(spark, sf), B.registry(spark, sf)).select("event_id", "agent_id", "signature")


@query("hmac_verify", with_ctes("", "decided", "registry").rstrip() + f""", {_LOG}
SELECT event_id, agent_id IN (SELECT agent_id FROM registry) AND row_id % 3 <> 0 AS signature_ok FROM log""")
def hmac_verify(spark, sf):
    signed = A.sign(_log(spark, sf), B.registry(spark, sf))
    forged = F.when(F.col("row_id") % 3 == 0, F.sha2("signature", 256)).otherwise(F.col("signature"))
    return A.verify_signatures(signed.withColumn("signature", forged), B.registry(spark, sf)).select("event_id", "signature_ok")


@query("chain_seal")
def chain_seal(spark, sf):
    """One committing hash per chain (the fold differs from plain SQL recursion, so rows only)."""
    return G.chain_seal(linked(spark, sf), "chain")
