import json

import pytest
from pyspark.sql import functions as F

from tracewarden import schema as S
from tracewarden.operators import ledger as G
from tracewarden.plans import bindings as B
from tracewarden.sources import files, lookups, models, store
from tracewarden.sources.tables import table
from tracewarden.streaming import retry, serving, windows
from tracewarden.streaming.commit import EVENT_COLUMNS, EVENT_SCHEMA, CommitLog, EvidenceCommitter


@pytest.fixture()
def events(spark, data, tmp_path):
    """Events as eight files, so that a stream takes several micro-batches."""
    e = table(spark, data, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("chain"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("payload_digest"), F.concat(F.lit("r"), F.col("user_id")).alias("resource_id"),
        F.col("event_id").alias("seq"), F.lit(0.0).alias("enqueued_sec"))
    path = str(tmp_path / "in")
    e.repartitionByRange(4, "seq").write.parquet(path)
    return path


def flaky(batch):
    """Ids divisible by 7 fail once, by 50 always."""
    i = F.col("event_id").cast("long")
    return batch.withColumn("error", F.when(i % 50 == 0, "down").when((i % 7 == 0) & (F.col("attempt") == 1), "busy"))


def stream(spark, path):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_loses_nothing_and_links_its_blocks(spark, events, tmp_path):
    clock = iter(range(0, 10_000, 10))
    committer = EvidenceCommitter(CommitLog(spark, str(tmp_path / "log")), flaky, clock=lambda: float(next(clock)))
    q = committer.start(stream(spark, events), str(tmp_path / "ckpt"))
    q.awaitTermination()
    # a restart from the checkpoint finds nothing new
    again = committer.start(stream(spark, events), str(tmp_path / "ckpt"))
    again.awaitTermination()
    committer.drain()

    submitted = spark.read.parquet(events)
    n = submitted.count()
    ids = [int(r[0]) for r in submitted.select("event_id").collect()]
    r = committer.accounting(submitted).first()
    dead = sum(i % 50 == 0 for i in ids)
    assert (r["submitted"], r["committed"], r["dead_lettered"], r["lost"], r["counted_twice"]) == (n, n - dead, dead, 0, 0)
    assert r["retried"] == sum(i % 7 == 0 and i % 50 != 0 for i in ids) and r["zero_loss"]

    blocks = committer.log.read("blocks")
    assert all(s["intact"] for s in G.chain_status(G.verify_chain(blocks, "chain"), "chain").collect())
    assert len(committer.log.epochs("pending")) >= 4
    records = committer.log.read("records")
    assert records.select("event_id").distinct().count() == records.count() == n - dead
    sums = records.groupBy("chain", "block_number").agg(F.count("*").alias("n")).join(blocks, ["chain", "block_number"])
    assert sums.where("n <> record_count").isEmpty()
    latency = windows.queue_latency(committer.log.read("outcomes")).agg(F.min("queue_sec")).first()[0]
    assert latency >= 0


def test_running_an_epoch_again_changes_nothing(spark, events, tmp_path):
    committer = EvidenceCommitter(CommitLog(spark, str(tmp_path / "log")), flaky, clock=lambda: 5.0)
    e = spark.read.parquet(events)
    first, second = e.where("seq < 300"), e.where("seq >= 200 and seq < 600")  # overlap: repeated ids
    committer.on_batch(first, 0)
    committer.on_batch(second, 1)
    before = sorted(committer.log.read("blocks").select("chain", "block_number", "hash").collect())
    committer.on_batch(second, 1)
    assert sorted(committer.log.read("blocks").select("chain", "block_number", "hash").collect()) == before
    outcomes = committer.log.read("outcomes")
    assert outcomes.count() == outcomes.select("event_id").distinct().count()


def test_repeated_submissions_leave_a_trace(spark, tmp_path):
    committer = EvidenceCommitter(CommitLog(spark, str(tmp_path / "log")))
    assert committer.drain() == 0 and committer.rejected() is None
    row = lambda i, seq, d="x": (str(i), "c0", d * 64, "r1", seq, 0.0)
    first = spark.createDataFrame([row(1, 1), row(2, 2), row(1, 3, "y")], EVENT_SCHEMA)
    second = spark.createDataFrame([row(2, 4, "z"), row(3, 5), row(3, 6)], EVENT_SCHEMA)
    committer.on_batch(first, 0)
    committer.on_batch(second, 1)
    assert sorted((r["event_id"], r["seq"], r["reason"]) for r in committer.rejected().collect()) == [
        ("1", 3, "repeated in the batch"), ("2", 4, "already settled"), ("3", 6, "repeated in the batch")]
    r = committer.accounting(first.unionByName(second)).first()
    assert (r["submitted"], r["committed"], r["rejected"], r["lost"], r["zero_loss"]) == (6, 3, 3, 0, True)
    r = committer.accounting(first.unionByName(second).unionByName(first.limit(1))).first()
    assert (r["lost"], r["zero_loss"]) == (1, False)
    # the view reads the committer's own log
    view = serving.ServingView(spark, committer.log.path("records"), str(tmp_path / "view"))
    assert view.sync(1.0) and view.frame().first()["events"] == 3


def test_time_is_compared_as_time(spark):
    rows = [("e1", "r", "2024-01-02T00:00:00.000+00:00"), ("e2", "r", "2024-01-01T23:59:59.000Z"), ("e3", "r", "2024-01-02T00:00:00.000Z")]
    log = spark.createDataFrame(rows, "event_id string, resource_id string, timestamp string")
    got = G.event_history(log, start="2024-01-02T00:00:00.000Z", end="2024-01-02T00:00:00.000Z")
    assert {r["event_id"] for r in got.collect()} == {"e1", "e3"}
    assert serving.latest_state(log, "resource_id").first()["last_event_id"] == "e3"
    assert [r["event_id"] for r in serving.by_resource(log, "r").collect()] == ["e2", "e1", "e3"]


def test_labels_outside_the_classes_are_reported_and_count_as_wrong(spark):
    from tracewarden.operators import learners as L

    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(40)] + [(1.0, "odd"), (2.0, None)], "x double, y string")
    assert {(r["label"], r["n"]) for r in L.label_rejects(df, "y", ["a", "b"]).collect()} == {("odd", 1), (None, 1)}
    assert L.fitting_rows(df, ["x"], "y", ["a", "b"]).count() == 40
    assert L.prepared(df, ["x"], "y", ["a", "b"], "keep").count() == 42
    with pytest.raises(Exception):
        L.prepared(df, ["x"], "y", ["a", "b"]).collect()


def test_batch_and_stream_commit_the_same_events(spark, events, tmp_path):
    whole = EvidenceCommitter(CommitLog(spark, str(tmp_path / "a")))
    whole.on_batch(spark.read.parquet(events), 0)
    streamed = EvidenceCommitter(CommitLog(spark, str(tmp_path / "b")))
    streamed.start(stream(spark, events), str(tmp_path / "ckpt")).awaitTermination()
    pick = lambda c: sorted(c.log.read("records").select("event_id", "payload_digest").collect())
    assert pick(whole) == pick(streamed)


def test_retry_states(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "attempt int, at double")
    rows = retry.with_state(df, "at", 10.06).collect()
    assert [r["state"] for r in rows] == ["due", "waiting", "dead_letter"]
    assert [round(r["next_try_sec"] - 10, 3) for r in rows] == [0.05, 0.1, 0.2]


def test_streaming_dedup_and_windows(spark, tmp_path):
    rows = [(i % 40, f"2024-01-01 0{i % 3}:00:00") for i in range(120)]
    spark.createDataFrame(rows, "event_id bigint, t string").select("event_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("event_id bigint, ts timestamp").parquet(str(tmp_path / "s"))
    q = windows.distinct_events(s, "ts", delay="5 hours").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 40
    q = windows.arrivals_per_interval(s, "ts").writeStream.format("memory").outputMode("complete").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["arrivals"] for r in spark.table("arrivals").collect()] == [40, 40, 40]


def test_serving_view_survives_a_failed_sync(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([("e1", "r", "2024-01-01"), ("e2", "r", "2024-01-02")], "event_id string, resource_id string, timestamp string").write.parquet(log)
    view = serving.ServingView(spark, log, str(tmp_path / "view"))
    assert view.frame() is None and view.staleness(5.0) is None
    assert view.sync(1.0) and view.frame().first()["last_event_id"] == "e2"
    view.log_path = str(tmp_path / "gone")
    assert not view.sync(9.0) and view.frame().count() == 1 and view.staleness(9.0) == 8.0
    fresh = spark.createDataFrame([("r", 1, "2024-01-03", "e3")], "resource_id string, events bigint, last_timestamp string, last_event_id string")
    merged = serving.merge_latest(view.frame(), fresh, "resource_id").first()
    assert (merged["events"], merged["last_event_id"]) == (3, "e3")


def test_store_put_twice_get_and_exists(spark, tmp_path):
    path = str(tmp_path / "store")
    p = spark.createDataFrame([("a",), ("b",), ("a",)], "payload string")
    store.put(spark, p, path)
    store.put(spark, p.union(spark.createDataFrame([("c",)], "payload string")), path)
    held = spark.read.parquet(path)
    assert sorted(r["payload"] for r in held.collect()) == ["a", "b", "c"]
    ask = store.as_stored(spark.createDataFrame([("a",), ("zz",)], "payload string")).select("content_address")
    assert [r["exists"] for r in store.exists(ask, held).orderBy("exists").collect()] == [False, True]
    assert sorted(str(r["payload"]) for r in store.get(ask, held).collect()) == ["None", "a"]


def test_alerts_round_trip_as_json_lines(spark, data, tmp_path):
    alerts = B.alerts(spark, data).select(*S.ALERT.fieldNames())
    path = str(tmp_path / "alerts")
    files.write_jsonl(alerts, path)
    rows, rejects = files.read_jsonl(spark, path, S.ALERT)
    files.require_stream(rows, rejects)
    assert rows.select("event_id", "event_hash", "confidence").exceptAll(alerts.select("event_id", "event_hash", "confidence")).isEmpty()
    from tracewarden.operators.evidence import alert_violations
    assert rows.where(F.size(alert_violations(["k", "value"])) > 0).isEmpty()

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('{"event_id":"1"}\n\n{broken\n{"event_id":"1"}\n')
    rows, rejects = files.read_jsonl(spark, str(tmp_path / "bad"), S.ALERT)
    assert rows.count() == 2 and rejects.first()["line"] == "{broken"
    with pytest.raises(ValueError, match="invalid JSON"):
        files.require_stream(rows, rejects)
    with pytest.raises(ValueError, match="duplicate"):
        files.require_stream(rows, rejects.where("false"))
    with pytest.raises(ValueError, match="empty"):
        files.require_stream(rows.where("false"), rejects.where("false"))


def test_csv_splits_and_predictions(spark, data, tmp_path):
    lines = B.lines(spark, data)
    lines.select("l_quantity", "category").coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    frozen = files.probe_csv_schema(spark, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), frozen)
    assert back.dtypes == [("l_quantity", "double"), ("category", "string")] and back.count() == lines.count()
    (tmp_path / "odd.csv").write_text("l_quantity,category\n1.5,A\nseven,R\n2.0,N\n")
    with pytest.raises(Exception):  # the cell does not fit the type
        files.read_csv(spark, str(tmp_path / "odd.csv"), frozen).collect()
    good, bad = files.read_csv_with_rejects(spark, str(tmp_path / "odd.csv"), frozen)
    assert sorted(r["l_quantity"] for r in good.collect()) == [1.5, 2.0] and [r["line"] for r in bad.collect()] == ["seven,R"]
    files.write_splits(lines, str(tmp_path / "splits"))
    val = files.read_split(spark, str(tmp_path / "splits"), "val", ["l_quantity"])
    assert val.count() == lines.where("split = 'val'").count()
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()
    scored = B.scored(spark, data).select(F.lit("m").alias("model"), "row_id", F.col("category").alias("y_true"), F.col("pred").alias("y_pred"), "prob")
    files.write_predictions(scored, str(tmp_path / "pred"))
    assert files.read_predictions(spark, str(tmp_path / "pred"), ["m"]).count() == scored.count()
    assert files.flatten_probabilities(scored, B.CLASSES).columns[-1] == "prob_Infiltration"


def test_policy_and_column_roles(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps({"confidence_threshold": 0.7, "category_thresholds": {"Bot": 0.1}}))
    policy = lookups.read_policy(spark, str(tmp_path / "policy.json"))
    assert (policy.confidence_threshold, policy.category_thresholds, policy.immediate_confidence_threshold) == (0.7, {"Bot": 0.1}, 0.99)
    roles = S.classify_columns(["IPV4_SRC_ADDR", "L4_DST_PORT", "Label", "Attack", "IN_BYTES"])
    assert (roles.identifiers, roles.labels, roles.features) == (["IPV4_SRC_ADDR", "L4_DST_PORT"], ["Label", "Attack"], ["IN_BYTES"])
    assert (S.multiclass_label(roles.labels), S.binary_label(roles.labels)) == ("Attack", "Label")
    assert S.truth_column(["x", "Label", "Attack"]) == ("Attack", "fine") and S.truth_column(["x"]) is None


def test_model_export_digest_and_reload(spark, data, tmp_path):
    from tracewarden.operators import learners as L

    train = L.with_balanced_weight(L.prepared(B.lines(spark, data), ["l_quantity", "l_tax"], "category", B.LINE_CLASSES), "category")
    model = L.BUILDERS["randomforest"](2, 3).fit(train)
    card = models.export_model(spark, model, str(tmp_path / "m"), ["l_quantity", "l_tax"], B.LINE_CLASSES, {"A": 1.0})
    loaded, again = models.load_model(spark, str(tmp_path / "m"))
    assert again.first()["model_digest"] == card.first()["model_digest"]
    artifact = card.first()["artifact_sha256"]
    other = models.model_card(spark, artifact, ["l_tax", "l_quantity"], B.LINE_CLASSES, {"A": 1.0}, {}).first()["model_digest"]
    assert other != card.first()["model_digest"]
    assert loaded.transform(train.limit(5)).select("prediction").count() == 5
    assert set(EVENT_COLUMNS) <= set(EVENT_SCHEMA.replace(",", "").split())
