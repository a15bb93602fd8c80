"""Log tables of merged runs, the incremental view, capture order, numbered lines and closed objects."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden import schema as S
from tracewarden.operators import evidence as E
from tracewarden.sources import capture
from tracewarden.sources.runs import Conflict, RunTable, pack_epochs, unpack_epochs
from tracewarden.streaming import serving


def epoch_rows(spark, epoch, n=50):
    return spark.createDataFrame([(f"e{epoch}-{i}", i) for i in range(n)], "event_id string, v int")


def test_runs_grow_with_the_logarithm(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "log"), "event_id", fanout=2)
    seen = []
    for epoch in range(20):
        runs.append(epoch_rows(spark, epoch * 1000, 5), epoch * 1000)
        seen.append(len(runs.manifest()[1]))
    assert max(seen) <= 7 and runs.epochs() == [e * 1000 for e in range(20)]
    assert len(runs.read().inputFiles()) <= 7
    held = runs.read()
    assert held.count() == held.select("event_id").distinct().count() == 100
    assert held.where("event_id like 'e7000-%'").select("epoch").distinct().collect()[0][0] == 7000
    assert runs.read(before=5000).count() == 25
    gone = runs.vacuum()
    assert gone and runs.read().count() == 100


def test_the_last_epoch_may_be_written_again(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "log"), "event_id", fanout=2)
    for epoch in range(6):
        runs.append(epoch_rows(spark, epoch), epoch)
    before, version = sorted(map(tuple, runs.read().collect())), runs.manifest()[0]
    runs.append(epoch_rows(spark, 5), 5)
    assert sorted(map(tuple, runs.read().collect())) == before
    runs.append(epoch_rows(spark, 5, 3), 5)
    assert runs.read_epoch(5).count() == 3 and runs.read(version=version).count() == len(before)
    with pytest.raises(ValueError):
        runs.append(epoch_rows(spark, 1), 1)  # has been merged


def test_a_look_up_opens_the_files_of_its_slots(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "log"), "event_id", fanout=2, rows_per_file=200)
    for epoch in range(5):
        runs.append(epoch_rows(spark, epoch, 1000), epoch)
    asked = spark.createDataFrame([("e1-7",), ("e3-999",), ("none",)], "event_id string")
    near = runs.near(asked)
    assert {r["event_id"] for r in near.join(asked, "event_id").collect()} == {"e1-7", "e3-999"}
    assert len(near.inputFiles()) <= 8 < len(runs.read().inputFiles())
    assert runs.near(asked, before=3).where("event_id = 'e3-999'").isEmpty()


def test_two_writers_cannot_both_publish(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "log"), "event_id")
    runs.append(epoch_rows(spark, 0), 0)
    version, held, epochs = runs.manifest()
    runs._publish(version + 1, held, epochs)
    with pytest.raises(Conflict):
        runs._publish(version + 1, held, epochs)


def test_empty_epochs_and_tables(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "log"), "event_id", fanout=2)
    assert runs.read() is None and runs.near(epoch_rows(spark, 0)) is None and runs.epochs() == []
    for epoch in range(5):
        runs.append(epoch_rows(spark, epoch).limit(0), epoch)
    assert runs.read().count() == 0 and runs.read().columns == ["event_id", "v", "epoch"] and runs.read_epoch(4).count() == 0
    runs.append(epoch_rows(spark, 5), 5)
    assert runs.read().count() == 50


def test_packed_epochs():
    for epochs in ([], [0], [5, 7], list(range(0, 9000, 1000)), [0, 1000, 2000, 2001, 2002, 9000, 12000]):
        assert unpack_epochs(pack_epochs(epochs)) == epochs
    assert len(pack_epochs(range(0, 10**6, 1000))) == 1


def test_a_sync_reads_new_epochs_only(spark, tmp_path):
    log = RunTable(spark, str(tmp_path / "log"), "event_id", fanout=3)
    view = serving.ServingView(spark, log.root, str(tmp_path / "view"), fanout=2)
    assert not view.sync(0.0) and view.event("x") is None

    def add(epoch):
        rows = [(f"e{epoch}-{i}", f"r{i % 3}", f"2024-01-0{1 + i % 5}T00:00:0{epoch}Z") for i in range(30)]
        log.append(spark.createDataFrame(rows, "event_id string, resource_id string, timestamp string"), epoch)

    opened = []
    for epoch in range(7):
        add(epoch)
        opened.append(len(log.since(set(view.table("latest").epochs())).inputFiles()))
        assert view.sync(float(epoch)) and view.sync(float(epoch) + 0.5)  # nothing new the second time
    assert opened == [1] * 7
    whole = serving.latest_state(log.read(), "resource_id")
    assert sorted(map(tuple, view.frame().collect())) == sorted(map(tuple, whole.collect()))
    assert view.event("e3-4").first()["resource_id"] == "r1" and view.event("nope").isEmpty()
    pinned = view.versions
    add(7)
    view.sync(9.0)
    assert view.frame(pinned).agg(F.sum("events")).first()[0] == 210 and view.frame().agg(F.sum("events")).first()[0] == 240
    ordered = [r["event_id"] for r in view.resource("r1").collect()]
    paged, after = [], None
    while page := view.resource("r1", after, 7).collect():
        paged += [r["event_id"] for r in page]
        after = (page[-1]["timestamp"], page[-1]["event_id"])
    assert len(ordered) == 80 and paged == ordered
    assert view.resource("r1", versions=pinned).count() == 70


# --- files -------------------------------------------------------------------------------------------
def test_capture_order_does_not_depend_on_splits(spark, tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    rng, want = random.Random(2), []
    for k in range(4):
        rows = [f"{k}-{i},{'x' * rng.randrange(40)}" for i in range(rng.choice([0, 1, 900, 3000]) if k else 2000)]
        (path / f"part{k}.csv").write_text("id,pad\n" + "".join(r + "\n" for r in rows))
        want += [r.split(",")[0] for r in rows]
    orders = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "30k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = spark.read.schema("id string, pad string").csv(str(path), header=True)
            got = capture.capture_order(raw, "n", file="file").where("id <> 'nothing'")
            orders.append([r["id"] for r in sorted(got.collect(), key=lambda r: r["n"])])
            assert sorted(r["n"] for r in got.collect()) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert orders == [want] * 3


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_numbered_lines(spark, tmp_path, size):
    texts = {"a.txt": "one\ntwo\r\n\nfour", "b.txt": "", "c.txt": "\n\n", "d.txt": "é" * 30 + "\nlast\n", "e.txt": "x" * 200}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in capture.read_numbered_lines(spark, str(tmp_path), split_bytes=size).collect()]
    want = [(name, i + 1, line.removesuffix("\r")) for name, text in texts.items() for i, line in enumerate(text.removesuffix("\n").split("\n") if text else [])]
    assert sorted(got) == sorted(want)
    for limit in (0, 1, 4, 5, 6, 100):
        some = capture.read_numbered_lines(spark, str(tmp_path), limit, size).collect()
        assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in some) == sorted(want[:limit])


def test_a_limit_leaves_the_rest_unread(tmp_path):
    (tmp_path / "a.txt").write_text("line\n" * 1_000_000)
    (tmp_path / "b.txt").write_text("never\n" * 10)
    parts = capture.LineReader({"path": str(tmp_path), "limit": "3", "split_bytes": "1000"}).partitions()
    assert [(p.file.rsplit("/", 1)[1], p.start, p.end) for p in parts] == [("a.txt", 0, 15)]


def test_jsonl_rejects_have_file_and_line(spark, tmp_path):
    lines = ['{"a":1,"b":"x"}', "", '{"a":"no"}', "{broken", '{"a":2,"c":true}', "[1]"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    shape = T.StructType.fromDDL("a long, b string")
    good, rejects = capture.read_numbered_jsonl(spark, str(tmp_path / "in.jsonl"), shape, split_bytes=9)
    assert sorted((r["line"], r["a"], r["b"]) for r in good.collect()) == [(1, 1, "x"), (5, 2, None)]
    assert sorted((r["line"], r["value"]) for r in rejects.collect()) == [(3, lines[2]), (4, lines[3]), (6, lines[5])]
    assert rejects.count() == 3 and {r[0] for r in rejects.select("line").collect()} == {3, 4, 6}
    good, rejects = capture.read_numbered_jsonl(spark, str(tmp_path / "in.jsonl"), shape, limit=3)
    assert good.count() == 1 and [capture.describe_reject(r).rsplit("/", 1)[1] for r in rejects.collect()] == ['in.jsonl:3: "{\\"a\\":\\"no\\"}"']


# --- closed objects ------------------------------------------------------------------------------------
def test_unknown_members_at_any_depth(spark):
    known = {f.name: None for f in S.EVIDENCE_EVENT.fields}
    texts = [
        known, known | {"x": 1}, known | {"model": {"model_id": "m", "color": {"deep": 1}}}, known | {"triggering_features": {"anything": 1}},
        known | {"feature_attributions": [{"feature": "f"}, {"rank": 1}, {"rank": 2, "z": None}, 3]}, known | {"model": 5, "calibration": None}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(6, "no json"), (7, None), (8, "[]")], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", E.unknown_members(F.col("t"), S.EVIDENCE_EVENT).alias("u")).collect()}
    assert got == {
        0: [], 1: ["unknown:x"], 2: ["unknown:model.color"], 3: [], 4: ["unknown:feature_attributions[].rank", "unknown:feature_attributions[].z"],
        5: [], 6: [], 7: [], 8: []}


# --- rows that must not go wrong unseen -------------------------------------------------------------------
def test_csv_rejects_go_by_the_header(spark, tmp_path):
    from tracewarden.sources import files

    shape = T.StructType.fromDDL("a int, b int, c string")
    (tmp_path / "one.csv").write_text('b,c,a\n1,"x,y",2\n3,z,no\n\n4,w,5\n6\n')
    good, bad = files.read_csv_with_rejects(spark, str(tmp_path / "one.csv"), shape)
    assert sorted(map(tuple, good.collect())) == [(2, 1, "x,y"), (5, 4, "w")]
    assert sorted((r["line_number"], r["line"], r["b"]) for r in bad.collect()) == [(3, "3,z,no", 3), (6, "6", 6)]
    assert bad.count() == 2 and sorted(r[0] for r in bad.select("line").collect()) == ["3,z,no", "6"]
    (tmp_path / "two.csv").write_text("a,b,c\n1,2,x\n")
    for wrong in (str(tmp_path), str(tmp_path / "one.csv")):
        with pytest.raises(ValueError):
            files.read_csv_with_rejects(spark, wrong, shape if wrong.endswith("tmp") or wrong == str(tmp_path) else T.StructType(shape.fields[:2]))


def test_a_float_that_loses_digits_stays_double(spark):
    from tracewarden.operators import cleaning

    df = spark.createDataFrame([(123456789.123, 0.5, float("nan")), (1.0, 2.0, None), (None, -3.25, 1.5)], "x double, y double, z double")
    plan = cleaning.plan_types(df, ["x", "y", "z"])
    assert plan == {"x": "double", "y": "float", "z": "float"}
    assert cleaning.narrow_types(df, plan).first()["x"] == 123456789.123


def test_payloads_that_disagree_are_no_proof(spark):
    import hashlib

    from tracewarden.operators import audit

    d = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3)]
    records = spark.createDataFrame([(f"e{i}", d[i], f"a{i}", "agent", "m") for i in range(3)], "event_id string, payload_digest string, content_address string, agent_id string, model_digest string")
    registry = spark.createDataFrame([("agent", "ab" * 32)], "agent_id string, key_hex string")
    payloads = [(f"a{i}", d[i], d[i]) for i in range(3)] + [("a1", d[2], d[2]), ("a2", d[2], d[2])]
    found = audit.audit(audit.sign(records, registry), spark.createDataFrame(payloads, "content_address string, claimed_digest string, recomputed_digest string"), registry, spark.createDataFrame([("m",)], "model_digest string"))
    assert {r["event_id"]: r["verdict"] for r in found.collect()} == {"e0": "VERIFIED", "e1": "TAMPERED", "e2": "VERIFIED"}


def test_a_policy_has_its_own_severities(spark, tmp_path):
    from tracewarden.sources import lookups

    (tmp_path / "p.json").write_text(json.dumps({"severity_by_threat": {"Bot": "CRITICAL"}}))
    policy = lookups.read_policy(spark, str(tmp_path / "p.json"))
    df = spark.createDataFrame([("Bot",), ("DDoS",)], "c string")
    assert [r[0] for r in df.select(policy.severity_of(F.col("c"))).collect()] == ["CRITICAL", "UNKNOWN"]
    assert [r[0] for r in df.select(type(policy)().severity_of(F.col("c"))).collect()] == ["HIGH", "HIGH"]
