"""Blocks from keyed state against the epoch path."""

import time

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import ledger as G
from tracewarden.sources.tables import table
from tracewarden.streaming.commit import EVENT_SCHEMA, CommitLog, EvidenceCommitter
from tracewarden.streaming.keyed import PROVIDER, keyed_blocks, keyed_conf

COLUMNS = ["chain", "block_number", "record_count", "merkle_root", "previous_hash", "hash"]


@pytest.fixture()
def keyed(spark):
    before = {k: spark.conf.get(k, None) for k in (*keyed_conf(), "spark.sql.shuffle.partitions")}
    for k, v in (keyed_conf() | {"spark.sql.shuffle.partitions": "2"}).items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def inputs(spark, data, tmp_path, parts=3):
    e = table(spark, data, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit('c"é'), F.col("user_id") % 3).alias("chain"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("payload_digest"), F.concat(F.lit("r"), F.col("user_id")).alias("resource_id"),
        F.col("event_id").alias("seq"), F.lit(0.0).alias("enqueued_sec"))
    path = str(tmp_path / "in")
    e.repartitionByRange(parts, "seq").write.parquet(path)
    return path


def run(frame, path, checkpoint, **trigger):
    def keep(batch, _):
        batch.write.mode("append").parquet(path)

    q = frame.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        q.awaitTermination()
    return q


def stream(spark, path, files=1):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def test_same_blocks_as_the_epoch_path_after_a_restart_too(keyed, data, tmp_path):
    spark, path = keyed, inputs(keyed, data, tmp_path)
    epochs = EvidenceCommitter(CommitLog(spark, str(tmp_path / "log")), batch_size=64)
    epochs.start(stream(spark, path), str(tmp_path / "a")).awaitTermination()
    run(keyed_blocks(stream(spark, path), 64), str(tmp_path / "out"), str(tmp_path / "b"))
    more = spark.read.parquet(path).limit(300).withColumns({"event_id": F.concat(F.lit("n"), "event_id"), "seq": F.col("seq") + 10**6})
    more.coalesce(1).write.mode("append").parquet(path)
    epochs.start(stream(spark, path), str(tmp_path / "a")).awaitTermination()
    run(keyed_blocks(stream(spark, path), 64), str(tmp_path / "out"), str(tmp_path / "b"))  # goes on from its state
    got, want = spark.read.parquet(str(tmp_path / "out")), epochs.log.read("blocks")
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(map(tuple, want.select(*COLUMNS).collect()))
    assert all(s["intact"] for s in G.chain_status(G.verify_chain(got.withColumn("segment", F.lit(0).cast("long")), "chain"), "chain").collect())


def flaky(event, attempt):
    i = int(event["event_id"])
    return "down" if i % 50 == 0 else "busy" if i % 7 == 0 and attempt == 1 else None


def test_timers_close_batches_and_retry(keyed, data, tmp_path):
    spark, path = keyed, inputs(keyed, data, tmp_path, 1)
    n = spark.read.parquet(path).count()
    dead = spark.read.parquet(path).where("event_id % 50 = 0").count()
    q = run(keyed_blocks(stream(spark, path), 64, hold_sec=1.0, commit=flaky, max_attempts=2), str(tmp_path / "out"), str(tmp_path / "c"), processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            out = spark.read.schema(keyed_blocks(spark.read.schema(EVENT_SCHEMA).parquet(path)).schema).parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else None
            done = out.select(F.sum(F.size("event_ids"))).first()[0] if out is not None else 0
            if done == n:
                break
    finally:
        q.stop()
    assert done == n
    assert out.where("error is not null").count() == dead and set(r[0] for r in out.where("error is not null").select("error").collect()) == {"down"}
    blocks = out.where("error is null")
    assert blocks.where("record_count > 64").isEmpty() and blocks.select(F.explode("event_ids")).distinct().count() == n - dead
    for chain in [r[0] for r in blocks.select("chain").distinct().collect()]:
        linked = blocks.where(F.col("chain") == chain).orderBy("block_number").collect()
        assert [b["block_number"] for b in linked] == list(range(len(linked)))
        assert all(a["hash"] == b["previous_hash"] for a, b in zip(linked, linked[1:]))


def test_provider_name():
    assert keyed_conf() == {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
