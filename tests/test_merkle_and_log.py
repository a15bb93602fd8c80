import hashlib

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import merkle as M
from tracewarden.operators import audit as A
from tracewarden.operators import ledger as G


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 100, 129])
def test_root_and_every_proof(spark, n):
    leaves = [digest(f"event-{i}") for i in range(n)]
    rows = [("c", 0, i, x) for i, x in enumerate(leaves)]
    df = spark.createDataFrame(rows, "chain string, batch_no bigint, leaf_index bigint, d string")
    root = G.batch_roots(df, "d", ["chain"]).first()["merkle_root"]
    assert root == plain_root(leaves)
    proofs = G.batch_proofs(df, "d", ["chain"]).withColumns({
        "good": M.merkle_verify(F.col("leaf"), F.col("proof"), F.col("merkle_root")),
        "wrong": M.merkle_verify(F.sha2("leaf", 256), F.col("proof"), F.col("merkle_root")),
    }).collect()
    assert len(proofs) == n and all(p["good"] for p in proofs) and not any(p["wrong"] for p in proofs)


def test_empty_batch_has_no_root(spark):
    assert spark.range(1).select(M.merkle_root(F.array().cast("array<string>"))).first()[0] is None


def roots(spark, chains=("a", "b"), n=25):
    rows = [(c, i, digest(f"{c}{i}"), 100) for c in chains for i in range(n)]
    return spark.createDataFrame(rows, "chain string, block_number bigint, merkle_root string, record_count bigint")


def test_links_are_sequential_within_segments_and_tied_by_the_spine(spark):
    blocks = G.link_blocks(roots(spark), "chain", segment_blocks=10)
    rows = {(r["chain"], r["block_number"]): r for r in blocks.collect()}
    assert rows[("a", 0)]["previous_hash"] == "0" * 64
    assert all(rows[("a", i)]["previous_hash"] == rows[("a", i - 1)]["hash"] for i in range(1, 25) if i % 10)
    spine = [r for r in G.segment_spine(blocks, "chain").orderBy("chain", "segment").collect() if r["chain"] == "a"]
    assert [s["head_hash"] for s in spine] == [rows[("a", i)]["hash"] for i in (9, 19, 24)]
    assert spine[1]["spine_hash"] == digest(spine[0]["spine_hash"] + spine[1]["head_hash"])
    seals = G.chain_seal(blocks, "chain", width=2, levels=2).collect()
    assert len({r["seal"] for r in seals}) == 2
    edited = blocks.withColumn("hash", F.when(F.col("block_number") == 9, F.sha2("hash", 256)).otherwise(F.col("hash")))
    assert not {r["seal"] for r in seals} & {r["seal"] for r in G.chain_seal(edited, "chain", width=2, levels=2).collect()}
    with pytest.raises(Exception, match="raise levels"):
        G.chain_seal(blocks, "chain", width=2, levels=1).collect()
    assert all(r["intact"] for r in G.chain_status(G.verify_chain(blocks, "chain", segment_blocks=10), "chain").collect())


def test_appending_continues_the_same_chain(spark):
    whole = G.link_blocks(roots(spark), "chain", segment_blocks=10)
    first = G.link_blocks(roots(spark).where("block_number < 13"), "chain", segment_blocks=10)
    rest = roots(spark).where("block_number >= 13").withColumn("block_number", F.col("block_number") - 13)
    second = G.link_blocks(rest, "chain", segment_blocks=10, heads=G.chain_heads(first, "chain"))
    columns = ["chain", "block_number", "hash"]
    assert sorted(first.union(second).select(columns).collect()) == sorted(whole.select(columns).collect())


@pytest.mark.parametrize("column,where", [("merkle_root", 3), ("hash", 24), ("previous_hash", 15)])
def test_any_edit_is_found(spark, column, where):
    blocks = G.link_blocks(roots(spark), "chain", segment_blocks=10)
    hit = (F.col("chain") == "a") & (F.col("block_number") == where)
    edited = blocks.withColumn(column, F.when(hit, F.lit(digest("edited"))).otherwise(F.col(column)))
    status = {r["chain"]: r["intact"] for r in G.chain_status(G.verify_chain(edited, "chain", segment_blocks=10), "chain").collect()}
    assert status == {"a": False, "b": True}


def test_a_removed_block_is_found(spark):
    blocks = G.link_blocks(roots(spark), "chain", segment_blocks=10).where("not (chain = 'a' and block_number = 4)")
    status = {r["chain"]: r["bad_links"] for r in G.chain_status(G.verify_chain(blocks, "chain", segment_blocks=10), "chain").collect()}
    assert status == {"a": 1, "b": 0}


def test_batches_follow_arrival_order_with_one_hot_chain(spark):
    rows = [(i * 3, "hot" if i % 3 else "cold") for i in range(1000)]
    df = spark.createDataFrame(rows, "seq bigint, chain string").repartition(8)
    got = G.assign_batches(df, "seq", ["chain"], 64).collect()
    for chain in ("hot", "cold"):
        ordered = sorted((r["seq"], r["batch_no"], r["leaf_index"]) for r in got if r["chain"] == chain)
        assert [(b, leaf) for _, b, leaf in ordered] == [divmod(i, 64) for i in range(len(ordered))]


def test_append_rejects_known_ids_and_keeps_the_first_of_a_batch(spark):
    batch = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 3, "known")], "id string, seq bigint, v string")
    log = spark.createDataFrame([("y",)], "id string")
    assert [tuple(r) for r in G.append_new(batch, log, "id", "seq").collect()] == [("x", 1, "early")]


def test_audit_verdicts(spark):
    registry = spark.createDataFrame([("agent", "ab" * 32)], "agent_id string, key_hex string")
    rows = [(f"e{i}", digest(f"p{i}"), f"addr{i}", "agent" if i != 3 else "stranger", "m1" if i else "m0") for i in range(5)]
    records = A.sign(spark.createDataFrame(rows, "event_id string, payload_digest string, content_address string, agent_id string, model_digest string"), registry)
    payloads = spark.createDataFrame(
        [(f"addr{i}", digest(f"p{i}"), digest(f"p{i}") if i != 1 else digest("edited")) for i in range(5) if i != 2],
        "content_address string, claimed_digest string, recomputed_digest string")
    provenance = spark.createDataFrame([("m1",)], "model_digest string")
    found = {r["event_id"]: r for r in A.audit(records, payloads, registry, provenance).collect()}
    assert [found[f"e{i}"]["verdict"] for i in range(5)] == ["VERIFIED", "TAMPERED", "INCOMPLETE", "TAMPERED", "VERIFIED"]
    assert found["e0"]["model_provenance_found"] is False and found["e4"]["model_provenance_found"] is True
