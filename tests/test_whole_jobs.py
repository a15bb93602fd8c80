"""Queries that do their whole job: chains linked from end to end, calibrated scores, a whole search."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_isotonic import pooled
from tracewarden.operators import cleaning
from tracewarden.operators import learners as L
from tracewarden.operators import ledger as G
from tracewarden.plans import bindings as B
from tracewarden.plans import model_queries as Q
from tracewarden.streaming import keyed


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def roots(spark, chains, n):
    rows = [(c, i, digest(f"{c}{i}"), 100) for c in chains for i in range(n)]
    return spark.createDataFrame(rows, "chain string, block_number bigint, merkle_root string, record_count bigint").repartition(5)


def plain_chain(chain, n):
    """(previous hash, hash) of every block in plain Python."""
    out, head = [], "0" * 64
    for i in range(n):
        own = digest(f'{{"chain":"{chain}","index":{i},"merkle_root":"{digest(f"{chain}{i}")}","previous_hash":"{head}","record_count":100}}')
        out.append((head, own))
        head = own
    return out


def test_links_run_through_the_whole_chain(spark):
    n = 2 * G.SEGMENT_BLOCKS + 7
    blocks = G.link_blocks(roots(spark, ["a", "b", "c"], n), "chain")
    got = {(r["chain"], r["block_number"]): (r["previous_hash"], r["hash"]) for r in blocks.collect()}
    assert got == {(c, i): x for c in "abc" for i, x in enumerate(plain_chain(c, n))}
    status = G.chain_status(G.verify_chain(blocks, "chain"), "chain").collect()
    assert sorted((r["chain"], r["blocks"], r["intact"]) for r in status) == [(c, n, True) for c in "abc"]


def test_a_chain_is_continued_behind_a_full_segment(spark):
    all_roots = roots(spark, ["a"], 25)
    first = G.link_blocks(all_roots.where("block_number < 20"), "chain", segment_blocks=10)
    rest = all_roots.where("block_number >= 20").withColumn("block_number", F.col("block_number") - 20)
    second = G.link_blocks(rest, "chain", segment_blocks=10, heads=G.chain_heads(first, "chain"))
    assert [(r["previous_hash"], r["hash"]) for r in second.orderBy("block_number").collect()] == plain_chain("a", 25)[20:]


@pytest.mark.parametrize("at", [9, 10])
def test_damage_at_the_border_of_segments_is_found(spark, at):
    blocks = G.link_blocks(roots(spark, ["a", "b"], 25), "chain", segment_blocks=10)
    hit = (F.col("chain") == "a") & (F.col("block_number") == at)

    def bad(frame):
        return {r["chain"]: r["bad_links"] for r in G.chain_status(G.verify_chain(frame, "chain", segment_blocks=10), "chain").collect()}

    assert bad(blocks.where(~hit)) == {"a": 1, "b": 0}
    # a block replaced together with its own hash no longer fits the next one
    root = F.when(hit, F.sha2("merkle_root", 256)).otherwise(F.col("merkle_root"))
    forged = blocks.withColumn("merkle_root", root)
    own = G.block_hash(F.col("chain"), F.col("block_number"), F.col("previous_hash"), F.col("merkle_root"), F.col("record_count"))
    assert bad(forged.withColumn("hash", F.when(hit, own).otherwise(F.col("hash")))) == {"a": 1, "b": 0}


def test_keyed_state_links_behind_a_full_segment():
    head, leaves = digest("head"), [digest("x")]
    root, previous, own = keyed.linked_block("a", G.SEGMENT_BLOCKS, head, leaves)
    assert previous == head and root == leaves[0]
    assert own == digest(f'{{"chain":"a","index":{G.SEGMENT_BLOCKS},"merkle_root":"{root}","previous_hash":"{head}","record_count":1}}')


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A small ``lineitem`` whose flag follows the quantity, with noise."""
    rng, path = random.Random(7), str(tmp_path_factory.mktemp("lines"))
    rows = []
    for i in range(900):
        quantity = float(rng.randint(1, 50))
        flag = rng.choice("NNAR") if rng.random() < 0.3 else "N" if quantity < 25 else rng.choice("AR")
        rows.append((i, i % 40, i % 7, 1, quantity, 10.0 * rng.random(), rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, flag))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_scored_batches_are_calibrated_on_the_val_fold(spark, lines):
    got = {r["l_orderkey"]: r for r in Q.score_batch(spark, lines).collect()}
    fold = lambda name: B.lines(spark, lines).where(F.col("split") == name)
    medians = cleaning.fit_medians(fold("train"), Q._FEATURES)
    model = L.fit_forest(fold("train"), Q._FEATURES, "category", B.LINE_CLASSES)
    raw = {name: L.with_attack_score(fold(name), model, Q._FEATURES, B.LINE_CLASSES, medians, "N", "raw").collect() for name in ("val", "test")}
    blocks = pooled([(r["raw"], int(r["category"] != "N")) for r in raw["val"]])
    x = [s for low, high, *_ in blocks for s in (low, high)]
    y = [positives / n for _, _, n, positives in blocks for _ in range(2)]
    want = dict(zip((r["l_orderkey"] for r in raw["test"]), np.interp([r["raw"] for r in raw["test"]], x, y)))
    assert len(got) == len(want) == 180
    assert all(got[k]["confidence"] == pytest.approx(want[k], abs=1e-9) and got[k]["anchor"] == (got[k]["confidence"] >= B.TAU) for k in want)
    assert any(abs(want[r["l_orderkey"]] - r["raw"]) > 0.01 for r in raw["test"])


def test_a_search_tries_as_many_settings_as_the_method(spark, lines):
    got = Q.hyper_search(spark, lines).orderBy("trial").collect()
    assert [r["trial"] for r in got] == list(range(40))
    assert len({r["settings"] for r in got}) > 30 and all(0 < r["f1"] <= 1 for r in got)


def test_models_are_compared_in_one_pass_over_the_test_rows(spark):
    label = F.when(F.col("id") % 7 < 3, "a").when(F.col("id") % 7 < 5, "b").otherwise("c")
    train = spark.range(0, 210, 1, 2).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), label.alias("y"))
    test = spark.range(0, 70, 1, 2).select((F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("z"), label.alias("y"))
    odd = spark.createDataFrame([(1.0, 1.0, None), (1.0, 1.0, "odd")], "x double, z double, y string")
    builders = {name: L.BUILDERS[name] for name in ("logreg", "boosted_ovr")}
    out = L.compare_models(train, test.unionByName(odd), ["x", "z"], "y", ["a", "b", "c"], "a", builders)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {r["model"]: r for r in out.collect()}
    assert set(got) == {"logreg", "boosted_ovr", "cascade"}
    # trees tell the classes apart, and labels outside the list count as wrong
    assert got["boosted_ovr"]["accuracy"] == pytest.approx(70 / 72) and got["cascade"]["accuracy"] == pytest.approx(70 / 72)
    fit_on = L.fitting_rows(train, ["x", "z"], "y", ["a", "b", "c"])
    alone = L.BUILDERS["logreg"](2, 3).fit(fit_on).transform(L.prepared(test, ["x", "z"], "y", ["a", "b", "c"]))
    assert got["logreg"]["accuracy"] == pytest.approx(alone.where(F.col("label") == F.col("prediction")).count() / 72)


def test_literal_weights_are_those_of_the_join(spark):
    rows = spark.range(0, 60).select(F.when(F.col("id") % 7 < 4, "a").when(F.col("id") % 7 < 6, "b").otherwise("c").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    told = L.with_balanced_weight(rows, "y").withColumn("literal", L.class_weight(F.col("y"), counts | {"d": 0}))
    assert told.where(F.col("weight") == F.col("literal")).count() == 60
