"""Independent check of committed records against payloads, keys and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import hmac_pads, hmac_sha256
from ..functions.merkle import merkle_verify
from ..functions.canonical import digest_claim_holds


def key_pads(registry: DataFrame) -> DataFrame:
    """(agent_id, inner_pad, outer_pad) of a registry with hex keys."""
    inner, outer = hmac_pads(F.col("key_hex"))
    # an agent with several keys has none that can be trusted: its signatures do not verify
    single = registry.groupBy("agent_id").agg(F.min("key_hex").alias("key_hex"), F.count_distinct("key_hex").alias("_keys")).where("_keys = 1")
    return single.select("agent_id", inner.alias("_inner"), outer.alias("_outer"))


def keyed_digest(digest: str) -> Column:
    return hmac_sha256(F.col("_inner"), F.col("_outer"), F.col(digest))


def sign(records: DataFrame, registry: DataFrame, digest: str = "payload_digest", agent: str = "agent_id") -> DataFrame:
    """Add ``signature``: the keyed digest under the agent's key; null for an unknown agent."""
    pads = key_pads(registry).withColumnRenamed("agent_id", agent)
    return records.join(pads, agent, "left").withColumn("signature", keyed_digest(digest)).drop("_inner", "_outer")


def verify_signatures(records: DataFrame, registry: DataFrame, digest: str = "payload_digest") -> DataFrame:
    """Add ``signature_ok``; unknown agents and missing signatures are false."""
    joined = records.join(key_pads(registry), "agent_id", "left")
    ok = F.coalesce(keyed_digest(digest) == F.lower("signature"), F.lit(False))
    return joined.withColumn("signature_ok", ok).drop("_inner", "_outer")


def audit(
    records: DataFrame, payloads: DataFrame, registry: DataFrame, provenance: DataFrame
) -> DataFrame:
    """Findings per committed record, three linear joins.

    ``payloads``: (content_address, claimed_digest, recomputed_digest). ``registry``: (agent_id,
    key_hex). ``provenance``: (model_digest). A missing payload is INCOMPLETE, any failed check is
    TAMPERED. Provenance is reported and does not change the verdict. Several payloads of one address that
    do not agree make it a failed one, whichever of them is right.
    """
    models = provenance.select("model_digest", F.lit(True).alias("model_provenance_found")).distinct()
    told = F.struct("claimed_digest", "recomputed_digest")
    single = payloads.groupBy("content_address").agg(F.min(told).alias("_told"), (F.min(told) == F.max(told)).alias("_agree"))
    single = single.select("content_address", F.col("_told.claimed_digest").alias("claimed_digest"), "_told.recomputed_digest", "_agree", F.lit(True).alias("_found"))
    joined = (
        records.join(single, "content_address", "left")
        .join(key_pads(registry), "agent_id", "left")
        .join(models, "model_digest", "left")
    )
    found = F.coalesce(F.col("_found"), F.lit(False))
    payload_ok = found & F.coalesce("_agree", F.lit(False)) & digest_claim_holds(F.col("claimed_digest"), F.col("recomputed_digest"))
    ledger_ok = found & F.coalesce(F.col("payload_digest") == F.col("claimed_digest"), F.lit(False))
    signature_ok = found & F.coalesce(
        keyed_digest("payload_digest") == F.col("signature"), F.lit(False)
    )
    checked = joined.withColumns({
        "payload_ok": payload_ok, "ledger_ok": ledger_ok, "signature_ok": signature_ok,
        "model_provenance_found": found & F.coalesce("model_provenance_found", F.lit(False)),
    })
    good = F.col("payload_ok") & F.col("ledger_ok") & F.col("signature_ok")
    reasons = F.concat_ws(
        "; ",
        F.when(~F.col("payload_ok"), "payload does not match its own digest"),
        F.when(~F.col("ledger_ok"), "committed digest differs from the payload"),
        F.when(~F.col("signature_ok"), "signature does not verify"),
    )
    return checked.withColumns({
        "verdict": F.when(~found, "INCOMPLETE").when(good, "VERIFIED").otherwise("TAMPERED"),
        "detail": F.when(~found, "payload unavailable").when(good, "all checks passed").otherwise(reasons),
    }).select(
        *records.columns, "payload_ok", "ledger_ok", "signature_ok", "model_provenance_found", "verdict", "detail"
    )


def with_inclusion_check(findings: DataFrame, proofs: DataFrame, leaf: str = "payload_digest") -> DataFrame:
    """Add ``included``: the record's digest is proven to be under its Merkle root (null if unbatched)."""
    paths = proofs.select(F.col("leaf").alias(leaf), F.col("merkle_root"), "proof")
    return findings.join(paths, [leaf, "merkle_root"], "left").withColumn(
        "included", F.when(F.col("merkle_root").isNotNull(), F.coalesce(
            merkle_verify(F.col(leaf), F.col("proof"), F.col("merkle_root")), F.lit(False)))
    ).drop("proof")


def compliance_report(findings: DataFrame, resource: str = "resource_id") -> DataFrame:
    """Counts per resource and, with a null resource, over everything."""
    verdict = F.col("verdict")
    return findings.rollup(resource).agg(
        F.count("*").alias("total_events"), F.count_if(verdict == "VERIFIED").alias("verified"),
        F.count_if(verdict == "TAMPERED").alias("tampered"), F.count_if(verdict == "INCOMPLETE").alias("incomplete"),
    ).withColumn("unbroken", (F.col("tampered") == 0) & (F.col("incomplete") == 0))


def provenance_trace(events: DataFrame, provenance: DataFrame) -> DataFrame:
    """Events with whether their model has an anchored provenance record."""
    models = provenance.select("model_digest", F.lit(True).alias("_p")).distinct()
    return events.join(models, "model_digest", "left").withColumn(
        "provenance_found", F.coalesce("_p", F.lit(False))
    ).drop("_p")
