"""The evidence chain end to end, as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import evidence as E
from ..operators import ledger as G
from ..operators.distributed import pin
from ..session import ensure_checkpoint_dir
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .rounding import rounded

_SQL = with_ctes("", "blocks", "registry").rstrip() + """,
r AS (SELECT b.threat_class AS category, b.decision, b.confidence, b.agent_id IN (SELECT agent_id FROM registry) AS signed, k.hash
  FROM batched b JOIN blocks k ON k.chain = b.chain AND k.block_number = b.batch_no)
SELECT category, count(*) AS anchored, count(*) FILTER (decision = 'immediate') AS immediate, count(*) FILTER (signed) AS verified,
  count(*) FILTER (NOT signed) AS tampered, count(DISTINCT hash) AS blocks, round(avg(confidence), 6) AS mean_confidence FROM r GROUP BY category"""


def anchored_records(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts through validation, digest, gate and batch: one row per anchored event."""
    d = B.decided(spark, sf)
    checked = pin(d.select(
        "row_id", "chain", "agent_id", "decision", "confidence", F.col("threat_class").alias("category"),
        F.col("event.payload_digest").alias("payload_digest"), F.size(E.alert_violations(["k", "value"])).alias("violations")))
    anchored = checked.where("violations = 0 and decision <> 'off_chain_only'").drop("violations")
    # ranking reads its input several times: hash each alert once, and keep what ranking needs
    ensure_checkpoint_dir(spark)
    return G.assign_batches(anchored.checkpoint(), "row_id", ["chain"], B.BATCH)


@query("evidence_chain", _SQL)
def evidence_chain_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Validate, digest, gate, batch, root, link, sign and check; summarised per category."""
    batched = anchored_records(spark, sf)
    roots = G.batch_roots(batched, "payload_digest", ["chain"]).withColumnRenamed("batch_no", "block_number")
    blocks = G.verify_chain(G.link_blocks(roots, "chain"), "chain").where("hash_ok and link_ok").select(
        "chain", F.col("block_number").alias("batch_no"), "hash")
    signed = A.sign(batched.join(blocks, ["chain", "batch_no"]), B.registry(spark, sf))
    ok = F.col("signature").isNotNull()
    return rounded(signed.groupBy("category").agg(
        F.count("*").alias("anchored"), F.count_if(F.col("decision") == "immediate").alias("immediate"),
        F.count_if(ok).alias("verified"), F.count_if(~ok).alias("tampered"),
        F.count_distinct("hash").alias("blocks"), F.avg("confidence").alias("mean_confidence")))
