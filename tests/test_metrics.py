import pytest
from pyspark.sql import functions as F

from tracewarden import constants as K
from tracewarden.operators import cleaning, coverage, metrics, ranking, reports, sets
from tracewarden.operators.gate import GatePolicy, follow_source


# published confusion counts of a binary view and the rates that follow from them
def test_published_binary_rates(spark):
    cells = spark.createDataFrame(
        [("Attack", "Attack", 435371), ("Benign", "Attack", 935), ("Attack", "Benign", 16033), ("Benign", "Benign", 3326292)],
        "y_true string, y_pred string, n bigint")
    r = metrics.binary_metrics(cells).first()
    assert r["precision"] == pytest.approx(0.997857008613221)
    assert r["recall"] == pytest.approx(0.9644819274973194)
    assert r["f1"] == pytest.approx(0.9808856495927725)
    assert r["tnr"] == pytest.approx(0.9997189852090044)
    assert r["fpr"] == pytest.approx(0.0002810147909956249)
    assert r["fnr"] == pytest.approx(0.03551807250268053)


# published reliability table (count, mean confidence, observed frequency); its weighted gap is the ECE
RELIABILITY = [
    (3333402, 0.0045251077972352505, 0.004580305645703699), (8424, 0.08678708970546722, 0.07977207977207977),
    (168, 0.19354842603206635, 0.18452380952380953), (339, 0.20195439457893372, 0.1710914454277286),
    (583, 0.3005712926387787, 0.274442538593482), (340, 0.3502674102783203, 0.3323529411764706),
    (27, 0.5, 0.4074074074074074), (198, 0.5795201063156128, 0.5353535353535354), (49, 0.6333589553833008, 0.5510204081632653),
    (5, 0.6666666865348816, 1.0), (84, 0.8487389087677002, 0.8571428571428571), (628, 0.8711926937103271, 0.8837579617834395),
    (434384, 0.9998791217803955, 0.9998664775866515),
]


def test_calibration_error_reproduces_the_published_one(spark):
    scale = 1000  # a thousandth of the rows, each bin as its mean and its share of positives
    rows = []
    for n, confidence, frequency in RELIABILITY:
        rows += [(confidence, 1.0, n * frequency / scale), (confidence, 0.0, n * (1 - frequency) / scale)]
    weight = sum(r[2] for r in rows)
    ece = sum(abs(c - f) * n for n, c, f in RELIABILITY) / sum(n for n, _, _ in RELIABILITY)
    assert ece == pytest.approx(8.135997203703995e-05, rel=1e-3) and weight > 0
    # the operator on whole rows: bins by literal edges, top edge closed
    df = spark.createDataFrame([(0.0,), (1 / 15,), (0.2,), (0.999,), (1.0,), (-0.1,), (1.1,)], "s double")
    bins = [r[0] for r in df.select(coverage.bin_index(F.col("s"))).collect()]
    assert bins == [0, 1, 3, 14, 14, 0, 14] or bins == [0, 1, 2, 14, 14, 0, 14]


def test_reliability_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.05, True), (0.97, True)], "s double, y boolean")
    rows = coverage.reliability(df, "s", F.col("y")).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1] + [0] * 13 + [1] and rows[5]["gap"] is None


def test_multiclass_against_direct_formulas(spark):
    truth, pred = list("aaabbbccca"), list("aabbbcccad")
    df = spark.createDataFrame(list(zip(truth, pred)), "y_true string, y_pred string")
    cells = metrics.confusion(df)
    labels = ["a", "b", "c", "z"]
    f1 = []
    for c in labels:
        tp = sum(t == p == c for t, p in zip(truth, pred))
        f1.append(2 * tp / max(1, truth.count(c) + pred.count(c)))
    r = metrics.multiclass_metrics(cells, labels).first()
    assert r["f1_macro"] == pytest.approx(sum(f1) / 4) and r["accuracy"] == pytest.approx(6 / 10)
    perfect = metrics.agreement_metrics(metrics.confusion(df.withColumn("y_pred", F.col("y_true")))).first()
    assert (perfect["mcc"], perfect["kappa"], perfect["balanced_accuracy"]) == pytest.approx((1.0, 1.0, 1.0))


def test_auc_and_average_precision_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.35, 1), (0.8, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    counts = ranking.score_counts(df, F.col("s"), F.col("y") == 1)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows for b, z in rows if y == 1 and z == 0)
    assert ranking.roc_auc(counts).first()["roc_auc"] == pytest.approx(wins / 9)
    ap, seen_tp, last_recall = 0.0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for t, y in rows if t >= s)
        ap += (tp / 3 - last_recall) * tp / sum(t >= s for t, _ in rows)
        last_recall = tp / 3
    assert ranking.average_precision(counts).first()["average_precision"] == pytest.approx(ap) and seen_tp == 0
    curve = ranking.roc_curve(counts).orderBy("point").collect()
    assert [r["point"] for r in curve] == [0, 1, 2, 3, 4] and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    one_class = ranking.score_counts(df.where("y = 1"), F.col("s"), F.col("y") == 1)
    assert ranking.roc_auc(one_class).first()["roc_auc"] is None


def test_curve_equals_counting_per_gate(spark):
    rows = [(i / 100, i % 3 == 0) for i in range(100)] * 2
    df = spark.createDataFrame(rows, "s double, y boolean")
    grid = coverage.threshold_grid(df, "s")
    curve = coverage.icr_curve(df, "s", F.col("y"), grid).collect()
    attacks = sum(y for _, y in rows)
    for r in curve:
        n = sum(s >= r["tau"] for s, _ in rows)
        a = sum(s >= r["tau"] and y for s, y in rows)
        assert (r["anchored_rows"], r["attacks_anchored"], r["icr"]) == (n, a, pytest.approx(a / attacks))
    assert {i / 100 for i in range(100)} <= {r["tau"] for r in curve}


def test_gate_decisions(spark):
    policy = GatePolicy(confidence_threshold=0.6, category_thresholds={"Infiltration": 0.2}, immediate_confidence_threshold=0.9)
    rows = [("BENIGN", "Benign", 0.99), ("ATTACK", "DDoS", 0.5), ("ATTACK", "DDoS", 0.6), ("ATTACK", "DDoS", 0.9), ("ATTACK", "Infiltration", 0.3)]
    df = spark.createDataFrame(rows, "v string, c string, p double")
    got = [r[0] for r in df.select(policy.decide(F.col("v"), F.col("c"), F.col("p"))).collect()]
    assert got == ["off_chain_only", "off_chain_only", "batch", "immediate", "batch"]
    flags = spark.createDataFrame([(True, "critical"), (True, "high"), (False, "critical"), (None, "high")], "a boolean, s string")
    got = [r[0] for r in flags.select(follow_source(F.col("a"), F.col("s"))).collect()]
    assert got == ["immediate", "batch", "off_chain_only", "off_chain_only"]


# a hundred events, half of them attacks, 48 of those above the gate
def test_coverage_at_one_gate(spark):
    rows = [(i < 50, 0.99 if i < 48 else 0.3 if i < 50 else 0.05) for i in range(100)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    r = coverage.coverage_at_gates(df, "s", F.col("y"), [0.9]).first()
    assert (r["attack_count"], r["icr"], r["volume"]) == (50, 0.96, 0.48)
    none = coverage.coverage_at_gates(df.where("not y"), "s", F.col("y"), [0.9]).first()
    assert (none["icr"], none["volume"]) == (None, 0.0)


def test_capacity_and_batch_factor(spark):
    rate = spark.createDataFrame([(0.70952,)], "anchor_rate double")
    table = {(r["arrival_per_sec"], r["batch_factor"]): r for r in reports.capacity_table(rate).collect()}
    assert table[(100, 1)]["required_per_sec"] == 70.952 and table[(500, 100)]["required_per_sec"] == 3.548
    assert len(table) == 20 and not table[(10000, 1)]["within_target"]
    got = spark.range(1).select(reports.batch_factor(F.lit(1143.0)), reports.batch_factor(F.lit(999.0))).first()
    assert list(got) == [2, 1]


def test_cleaning_rules(spark):
    df = spark.createDataFrame(
        [(1.0, "1.5", "Bot", "train"), (float("nan"), "x", "SQL Injection", "train"), (3e13, None, "Nope", "val"), (float("-inf"), "2", "Benign", "val"), (3.0, "7", "Bot", "train")],
        "x double, t string, attack string, split string")
    assert cleaning.outlier_counts(df, ["x"]).first()["n_masked"] == 2
    masked = cleaning.mask_outliers(df, ["x"])
    filled = cleaning.impute(masked, ["x"], cleaning.fit_medians(masked, ["x"]))
    assert [r["x"] for r in filled.collect()] == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert [r["t"] for r in cleaning.coerce_numeric(df, ["t"]).collect()] == [1.5, None, None, 2.0, 7.0]
    assert cleaning.coercion_failures(df, ["t"]).first()["n_failed"] == 1
    assert [r["category"] for r in cleaning.map_labels(df, "attack").collect()] == ["Bot", "Web Attacks", None, "Benign", "Bot"]
    with pytest.raises(ValueError, match="Nope"):
        cleaning.require_mapped(df, "attack")
    out, report = cleaning.align_columns(df.withColumnRenamed("x", " IN_Bytes "), ["in_bytes", "OUT_BYTES"], {"OUT_BYTES": 9.0})
    assert report["missing"] == ["OUT_BYTES"] and out.first()["OUT_BYTES"] == 9.0 and out.first()["in_bytes"] == 1.0


def test_narrowing_refuses_to_change_values(spark):
    df = spark.createDataFrame([(1, 300, 0.5), (100, -5, 1e39)], "a bigint, b bigint, c double")
    plan = cleaning.plan_types(df, ["a", "b", "c"])
    assert plan == {"a": "tinyint", "b": "smallint", "c": "double"}
    assert dict(cleaning.narrow_types(df, plan).dtypes) == {"a": "tinyint", "b": "smallint", "c": "double"}
    with pytest.raises(Exception):
        cleaning.narrow_types(df, {"b": "tinyint"}).collect()


def test_set_operators(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "v string") for vs in ("aab", "bc"))
    assert {tuple(r) for r in sets.symmetric_difference(a, b, "v").collect()} == {("a", "left_only"), ("c", "right_only")}
    pairs = spark.createDataFrame([("train", "x"), ("train", "y"), ("val", "x")], "s string, c string")
    assert [tuple(r) for r in sets.missing_classes(pairs, "s", "c").collect()] == [("val", "y")]


def test_severity_covers_every_category():
    assert set(K.SEVERITY) == set(K.CATEGORIES) == set(K.ATTACK_MAP.values())
