"""Blocks of the isotonic fit against Spark ML and brute force."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tracewarden.operators import isotonic, learners


def pooled(rows):
    """Pool adjacent violators in plain Python: (low, high, n, positives)."""
    sums = {}
    for s, y in rows:
        a = sums.setdefault(s, [0, 0])
        a[0], a[1] = a[0] + 1, a[1] + y
    out = []
    for s in sorted(sums):
        out.append([s, s, *sums[s]])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return [tuple(b) for b in out]


@pytest.mark.parametrize("fan", [2, 16])
@pytest.mark.parametrize("kind", ["noisy", "rising", "falling", "ties"])
def test_blocks_against_pooling(spark, kind, fan, monkeypatch):
    monkeypatch.setattr(isotonic, "FAN_IN", fan)
    rng = random.Random(4)
    score = {"noisy": lambda i: rng.random(), "rising": lambda i: float(i), "falling": lambda i: float(i), "ties": lambda i: float(rng.randrange(12)) - 3}[kind]
    label = {"noisy": lambda s: int(rng.random() < s), "rising": lambda s: int(s > 200), "falling": lambda s: int(s < 200), "ties": lambda s: int(rng.random() < (s + 3) / 12)}[kind]
    rows = [(s, label(s)) for s in (score(i) for i in range(400))]
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 1), (0.5, None)], "s double, y int").repartition(5)
    got = isotonic.isotonic_blocks(df, "s", F.col("y")).orderBy("block").collect()
    assert [(r["low"], r["high"], r["n"], r["positives"]) for r in got] == pooled(rows)
    assert [r["block"] for r in got] == list(range(len(got))) and all(a["value"] < b["value"] for a, b in zip(got, got[1:]))
    model = IsotonicRegression(featuresCol="s", labelCol="label", weightCol="weight").fit(learners._per_score(df.where("s is not null and not isnan(s) and y is not null"), "s", F.col("y")))
    at = dict(zip(model.boundaries.toArray(), model.predictions.toArray()))
    assert all(at[r[c]] == pytest.approx(r["value"], abs=1e-12) for r in got for c in ("low", "high") if r[c] in at)


def test_no_scores_no_blocks(spark):
    assert isotonic.isotonic_blocks(spark.createDataFrame([(None, 1)], "s double, y int"), "s", F.col("y")).collect() == []
