import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import distributed as X
from tracewarden.operators import ordering, profile, reports, sampling
from tracewarden.operators.selection import stump_screen


def test_running_totals_with_a_group_holding_most_rows_and_a_null_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 6 + ["small", None]), v, rng.randint(1, 9)) for v in range(2000)]
    df = spark.createDataFrame(rows, "g string, v bigint, n bigint").repartition(8)
    got = {(r["g"], r["v"]): (r["n_before"], r["n_total"]) for r in X.running_totals(df, "v", ["n"], ["g"]).collect()}
    assert len(got) == len(rows)
    for g in ("big", "small", None):
        ordered = sorted((v, n) for h, v, n in rows if h == g)
        total, before = sum(n for _, n in ordered), 0
        for v, n in ordered:
            assert got[(g, v)] == (before, total)
            before += n


def test_scores_clustered_near_one_spread_over_buckets(spark):
    values = sorted({1 - 1e-9 * i for i in range(3000)} | {0.0})
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n bigint")
    sizes = [r["count"] for r in X.ranged(df, ["v"]).groupBy("_bucket").count().collect()]
    assert max(sizes) < len(values) / 4
    got = [r["n_before"] for r in X.running_totals(df, "v", ["n"]).orderBy("v").collect()]
    assert got == list(range(len(values)))


def test_sparse_ids_and_a_group_of_nearly_all_rows_spread_over_buckets(spark):
    rng = random.Random(9)
    ids = sorted({rng.randrange(1 << 62) for _ in range(5000)})
    df = spark.createDataFrame([(i, "rare" if k % 100 == 0 else "big") for k, i in enumerate(ids)], "id bigint, g string").repartition(8)
    sizes = [r["count"] for r in X.ranged(df, ["g", "id"]).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < len(ids) / 3
    position = {r["id"]: r["position"] for r in X.row_positions(df, "id").collect()}
    assert [position[i] for i in ids] == list(range(len(ids)))
    within = {r["id"]: (r["position"], r["position_total"]) for r in X.row_positions(df, "id", ["g"]).collect()}
    rare = [i for k, i in enumerate(ids) if k % 100 == 0]
    assert [within[i] for i in rare] == [(k, 50) for k in range(50)]


def test_exact_percentiles_match_numpy(spark):
    rng = random.Random(5)
    values = [round(rng.expovariate(0.1), 1) for _ in range(999)]
    df = spark.createDataFrame([(v, "a" if i % 5 else "b") for i, v in enumerate(values)], "x double, g string")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    for r in X.exact_percentiles(df, ["x"], ps, ["g"]).collect():
        own = [v for i, v in enumerate(values) if ("a" if i % 5 else "b") == r["g"]]
        assert [r[f"p{i}"] for i in range(5)] == pytest.approx(list(np.quantile(own, ps)))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantile_grid_matches_numpy(spark, n):
    rng = random.Random(n)
    values = [round(rng.random(), 2) for _ in range(n)]
    ranked = X.running_totals(X.value_counts(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]), "value", ["n"])
    wide, top = [i / 399 for i in range(400)], [0.85 + 0.15 * i / 599 for i in range(600)]
    got = {(r["grid"], r["i"]): r["quantile"] for r in X.quantile_grids(ranked, [(wide, F.lit(True)), (top, F.lit(True))]).collect()}
    assert len(got) == 1000
    for g, probabilities in enumerate((wide, top)):
        assert [got[(g, i)] for i in range(len(probabilities))] == pytest.approx(list(np.quantile(values, probabilities)))


def test_positional_split_and_positions(spark):
    ids = sorted(random.Random(2).sample(range(10_000), 503))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(8)
    split = {r["id"]: r["split"] for r in ordering.positional_split(df, "id").collect()}
    a, b = int(503 * 0.6), int(503 * 0.6) + int(503 * 0.2)
    assert [split[i] for i in ids] == ["train"] * a + ["val"] * (b - a) + ["test"] * (503 - b)
    position = {r["id"]: r["position"] for r in ordering.row_position(df, "id").collect()}
    assert [position[i] for i in ids] == list(range(503))


def test_keep_first_of_a_row_repeated_many_times(spark):
    rows = [(i, "same", 1.0) for i in range(5, 4000)] + [(1, "other", float("nan")), (2, "other", float("nan"))]
    kept = ordering.keep_first(spark.createDataFrame(rows, "id bigint, s string, x double").repartition(8), "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 5]


def by_hash(ids, k, seed=42):
    return set(sorted(ids, key=lambda i: hashlib.sha256(f"{i}:{seed}".encode()).hexdigest())[:k])


def test_samples_are_exact_and_do_not_depend_on_partitioning(spark):
    rows = [(i, "big" if i % 10 else "rare") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, c string")
    for parts in (1, 8):
        got = {r["id"] for r in sampling.sample_n(df.repartition(parts), "id", 100).collect()}
        assert got == by_hash(range(3000), 100)
        capped = sampling.class_cap(df.repartition(parts), "id", "c", 400).collect()
        assert {r["id"] for r in capped if r["c"] == "big"} == by_hash([i for i, c in rows if c == "big"], 400)
        assert {r["id"] for r in capped if r["c"] == "rare"} == {i for i, c in rows if c == "rare"}


def test_sample_larger_than_the_table_is_the_table(spark):
    df = spark.range(50)
    assert sampling.sample_n(df, "id", 500).count() == 50 and sampling.sample_n(df, "id", 50).count() == 50


def test_quota_plan_hands_shortfall_to_attack_classes_only():
    counts = {"Benign": 1000, "Bot": 3, "DDoS": 100, "DoS": 6}
    plan = sampling.quota_plan(counts, {"Benign": 10, "Bot": 10, "DDoS": 5, "DoS": 5})
    assert plan == {"Benign": 10, "Bot": 3, "DDoS": 11, "DoS": 6}


def test_longest_run(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 1, 0, 1]
    df = spark.createDataFrame(list(enumerate(flags)), "i bigint, f int")
    assert reports.longest_run(df, "i", F.col("f") == 1).first()[0] == 4
    assert reports.longest_run(df, "i", F.col("f") == 7).first()[0] == 0


def test_stump_screen_finds_a_leaking_feature(spark):
    rng = random.Random(4)
    rows = [("a" if i % 2 else "b", float(i % 2) + rng.random() * 0.1, rng.random(), 1.0) for i in range(800)]
    df = spark.createDataFrame(rows, "y string, leak double, noise double, const double")
    got = {r["feature"]: r for r in stump_screen(df.limit(400), df, ["leak", "noise", "const"], "y", ["a", "b"]).collect()}
    assert got["leak"]["solo_macro_f1"] == 1.0 and got["leak"]["flagged"]
    assert not got["noise"]["flagged"] and got["const"]["solo_macro_f1"] == pytest.approx(1 / 3)


def test_profile_counts_nan_and_infinity_apart(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "x double")
    r = profile.column_profile(df, ["x"]).first()
    assert (r["n_missing"], r["n_infinite"], r["min_value"], r["max_value"], r["zero_variance"]) == (2, 1, 1.0, 3.0, False)


def test_plans_have_no_cross_join_and_push_filters(spark, data):
    from tracewarden.plans import bindings as B

    f = B.flow(spark, data)
    for df in (ordering.positional_split(f, "row_id"), sampling.class_cap(f, "row_id", "category", 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = B.flow(spark, data).where("user_id = 3").select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in scan and "props" not in scan


def test_replayed_alerts_are_valid_and_hit_the_ratio(spark, data):
    from tracewarden.operators.evidence import alert_violations
    from tracewarden.plans import bindings as B

    draws = B.flow(spark, data).select(F.col("row_id").alias("draw"))
    out = sampling.replay_resample(B.alerts(spark, data), "row_id", draws, "draw", 0.25, 10)
    r = out.agg(
        F.count("*").alias("n"), F.avg((F.col("verdict") == "ANOMALY").cast("double")).alias("ratio"),
        F.count_if(F.size(alert_violations(["k", "value"])) > 0).alias("bad"), F.count_distinct("event_id").alias("ids")).first()
    assert r["n"] == r["ids"] == draws.count() and abs(r["ratio"] - 0.25) < 0.05 and r["bad"] == 0


def test_many_groups(spark):
    rows = [(i % 20, i // 20, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "g bigint, v bigint, n bigint").repartition(8)
    got = X.running_totals(df, "v", ["n"], ["g"]).collect()
    assert len(got) == 2000 and all(r["n_before"] == r["v"] and r["n_total"] == 100 for r in got)


def test_borders_do_not_change_between_branches(spark):
    """Continuous values from many partitions: merged sketches differ from run to run."""
    df = spark.range(200_000, numPartitions=32).select(
        (F.col("id") % 2).alias("g"), F.rand(1).alias("v"), F.lit(1).cast("long").alias("n")).persist()
    ranked = X.running_totals(df, "v", ["n"], ["g"])
    bad = ranked.groupBy("g").agg(F.count_distinct("n_before").alias("d"), F.max("n_before").alias("top"), F.count("*").alias("c"))
    assert all(r["d"] == r["c"] and r["top"] == r["c"] - 1 for r in bad.collect())
    df.unpersist()
