"""Files and log tables: capture order, numbered lines, closed objects, merged epochs, the serving view.

The given tables are written to a folder of the shared checkpoint location first, and what is checked is read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import schema as S
from ..operators import evidence as E
from ..session import ensure_checkpoint_dir
from ..sources import capture
from ..sources.runs import RunTable
from ..sources.tables import table
from ..streaming import serving
from ..streaming.keyed import keyed_blocks, keyed_conf
from . import bindings as B
from .bindings import with_ctes
from .catalog import query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the location that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/store/{name}-{uuid.uuid4().hex}"


@query("capture_order", """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS capture_order FROM lineitem""")
def capture_order(spark, sf):
    """Positions of the rows of a raw CSV capture that has no number of its own."""
    path, keys = scratch(spark, "capture"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*keys, "l_quantity")
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("header", True).csv(path)
    raw = spark.read.schema(rows.schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return capture.capture_order(raw).select("l_orderkey", "l_linenumber", "l_partkey", "capture_order")


_LINE = """CASE WHEN event_id % 97 = 0 THEN '{"event_id":' || event_id WHEN event_id % 101 = 0 THEN '{"event_id":"x' || event_id || '"}'
  WHEN event_id % 89 = 0 THEN '' ELSE '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' END"""


@query("jsonl_rejects", f"""
SELECT part, line, value FROM (
  SELECT event_id, event_id // 4000 AS part, {_LINE} AS value, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) AS line FROM events)
WHERE event_id % 97 = 0 OR event_id % 101 = 0""")
def jsonl_rejects(spark, sf):
    """File and line of every line that is no record: cut off, or of another type."""
    path = scratch(spark, "lines")
    lines = table(spark, sf, "events").select("event_id", F.expr("event_id div 4000").alias("part"), F.expr(_LINE).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    shape = T.StructType.fromDDL("event_id long, user_id long, event_type string")
    _, rejects = capture.read_numbered_jsonl(spark, path, shape, split_bytes=1 << 17)
    return rejects.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), "line", "value")


_OBJECT = """'{"event_id":"' || event_id || '","verdict":"ATTACK"' || CASE WHEN event_id % 11 = 0 THEN ',"note":null' ELSE '' END
  || ',"triggering_features":{"k' || user_id || '":1},"model":{"model_id":"m"' || CASE WHEN event_id % 7 = 0 THEN ',"color":"red","age":3' ELSE '' END
  || '},"feature_attributions":[{"feature":"k","contribution":0.5}' || CASE WHEN event_id % 5 = 0 THEN ',{"feature":"v","rank":{"feature":1}}' ELSE '' END
  || CASE WHEN event_id % 13 = 0 THEN ']' ELSE '],"calibration":{"method":"none"}}' END"""


def _others(path: str, shape: T.StructType) -> str:
    return f"[x FOR x IN json_keys(t, '{path}') IF NOT list_contains({shape.fieldNames()}, x)]"


_ATTRIBUTION = S.EVIDENCE_EVENT["feature_attributions"].dataType.elementType


@query("closed_object", f"""
WITH texts AS (SELECT event_id, {_OBJECT} AS t FROM events),
codes AS (
  SELECT event_id, unnest(['unknown:' || x FOR x IN {_others('$', S.EVIDENCE_EVENT)}]
    || ['unknown:model.' || x FOR x IN {_others('$.model', S.EVIDENCE_EVENT['model'].dataType)}]
    || ['unknown:feature_attributions[].' || x FOR x IN flatten([json_keys(a) FOR a IN from_json(json_extract(t, '$.feature_attributions'), '["JSON"]')])
        IF NOT list_contains({_ATTRIBUTION.fieldNames()}, x)]) AS code
  FROM texts WHERE json_valid(t))
SELECT event_id, coalesce(string_agg(code, '|' ORDER BY code), '') AS unknown FROM texts LEFT JOIN codes USING (event_id) GROUP BY event_id""")
def closed_object(spark, sf):
    """Members of evidence texts that the contract does not know, at any depth; cut off texts have none."""
    texts = table(spark, sf, "events").select("event_id", F.expr(_OBJECT).alias("text"))
    return texts.select("event_id", F.array_join(E.unknown_members(F.col("text"), S.EVIDENCE_EVENT), "|").alias("unknown"))


_EPOCH = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query("log_merge", f"SELECT event_id, user_id, CAST({_EPOCH} AS BIGINT) AS epoch FROM events")
def log_merge(spark, sf):
    """Epochs of a log, the last one written twice, merged into runs and read back."""
    runs = RunTable(spark, scratch(spark, "log"), "event_id", fanout=2)
    events = table(spark, sf, "events").select("event_id", "user_id", F.expr(_EPOCH).alias("own"))
    for epoch in (0, 1, 2, 3, 4, 4):
        runs.append(events.where(F.col("own") == epoch).drop("own"), epoch)
    return runs.read().select("event_id", "user_id", F.col("epoch").cast("long").alias("epoch"))


@query("log_lookup", f"""
SELECT event_id, count(*) AS found, CAST(min({_EPOCH}) AS BIGINT) AS epoch FROM events WHERE event_id IN (SELECT o_orderkey FROM orders) GROUP BY event_id""")
def log_lookup(spark, sf):
    """Which of a batch of ids a merged log has settled, from the files that may hold them."""
    runs = RunTable(spark, scratch(spark, "settled"), "event_id", fanout=2, rows_per_file=2000)
    events = table(spark, sf, "events").select("event_id", F.expr(_EPOCH).alias("own"))
    for epoch in range(5):
        runs.append(events.where(F.col("own") == epoch).drop("own"), epoch)
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("event_id")).distinct()
    held = runs.near(asked).join(asked, "event_id")
    return held.groupBy("event_id").agg(F.count("*").alias("found"), F.min("epoch").cast("long").alias("epoch"))


@query("serving_sync", with_ctes("""
SELECT resource_id, count(*) AS events, max(timestamp) AS last_timestamp, arg_max(event_id, timestamp || event_id) AS last_event_id FROM decided
WHERE decision <> 'off_chain_only' GROUP BY resource_id""", "decided"))
def serving_sync(spark, sf) -> DataFrame:
    """Latest state per resource of a view that is synced after every second epoch and reads new epochs only."""
    records = B.decided(spark, sf).where("decision <> 'off_chain_only'").select(
        "event_id", "timestamp", F.coalesce("cloud_resource_id", F.lit(K.UNMAPPED_RESOURCE)).alias("resource_id"), (F.crc32("event_id") % 4).alias("own"))
    path = scratch(spark, "decided")
    records.write.parquet(path)  # digested once, and read by every epoch
    log = RunTable(spark, scratch(spark, "records"), "event_id", fanout=2)
    view = serving.ServingView(spark, log.root, scratch(spark, "view"), fanout=2)
    for epoch in range(4):
        log.append(spark.read.parquet(path).where(F.col("own") == epoch).drop("own"), epoch)
        if epoch % 2:
            view.sync(float(epoch))
    return view.frame()


@query("keyed_blocks", with_ctes("SELECT chain, batch_no AS block_number, record_count, merkle_root FROM roots", "roots"))
def keyed_chain(spark, sf) -> DataFrame:
    """Blocks of every chain from a stream whose heads are keyed state."""
    path, out = scratch(spark, "stream"), scratch(spark, "blocks")
    rows = B.batched(spark, sf).select("chain", "event_id", "payload_digest", (F.col("batch_no") * B.BATCH + F.col("leaf_index")).alias("seq"))
    rows.write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in keyed_conf()}
    try:
        for k, v in keyed_conf().items():
            spark.conf.set(k, v)
        blocks = keyed_blocks(spark.readStream.schema(rows.schema).parquet(path), B.BATCH)
        blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(blocks.schema).parquet(out).select("chain", "block_number", "record_count", "merkle_root")
