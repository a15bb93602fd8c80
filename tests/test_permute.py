"""Keyed permutations are exact, differ by key, and give the importance of a column."""

import hashlib

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracewarden.functions.permute import permuted_position, with_permuted_position
from tracewarden.operators import learners as L


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 101, 1000, 9999])
def test_every_position_is_taken_once(spark, n):
    df = spark.range(n).select("id", *[permuted_position(F.col("id"), F.lit(n).cast("long"), k).alias(f"p{k}") for k in (1, 2)])
    rows = df.collect()
    for k in (1, 2):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(n))
    if n >= 1000:
        assert sum(r["p1"] == r["p2"] for r in rows) < 20 and sum(r["p1"] == r["id"] for r in rows) < 20
        mean = sum(r["id"] * r["p1"] for r in rows) / n
        assert abs(mean / ((n - 1) / 2) ** 2 - 1) < 0.05  # no trend from old to new place


def test_importance_of_the_only_column_that_counts(spark):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("double").alias("x"), F.rand(3).alias("z"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    fit = L.fitting_rows(rows, ["x", "z"], "y", ["a", "b"])
    model = Pipeline(stages=[LogisticRegression(labelCol="label")]).fit(fit)
    got = {r["feature"]: r["importance"] for r in L.permutation_importance(model, rows, "row_id", ["x", "z"], "y", ["a", "b"]).collect()}
    assert got["x"] == pytest.approx(0.5, abs=0.08) and abs(got["z"]) < 0.02


def test_draws_stay_as_they_were(spark):
    got = spark.range(17).select(permuted_position(F.col("id"), F.lit(17).cast("long"), 1).alias("p")).collect()
    assert [r["p"] for r in got] == [3, 4, 7, 14, 0, 12, 1, 13, 11, 5, 16, 6, 8, 9, 2, 10, 15]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 101, 9999])
def test_projections_give_the_places_of_the_expression(spark, n):
    df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.explode(F.array(F.lit(1), F.lit(42))).alias("k"))
    out = with_permuted_position(df, "id", "n", F.col("k"), "p")
    assert out.columns == ["id", "n", "k", "p"]
    assert out.where(F.col("p").eqNullSafe(permuted_position(F.col("id"), F.col("n"), F.col("k")))).count() == 2 * n


def _guess(x, z):
    return float((x + (z == 2)) % 2)


class _Counted:
    """A model that guesses from the features and counts the rows that it scores."""

    def __init__(self, spark):
        self.scored = spark.sparkContext.accumulator(0)

    def transform(self, df):
        scored = self.scored

        @F.udf("double")
        def guess(v):
            scored.add(1)
            return _guess(*v)

        return df.withColumn("prediction", guess(vector_to_array("features")))


def test_importance_is_that_of_the_shuffled_rows_read_twice_and_scored_once(spark):
    n, repeats, seed, features = 90, 3, 7, ["x", "z"]
    rows = [(f"r{i}", float(i % 2), float(i % 3), None if i % 10 == 0 else "c" if i % 10 == 1 else "ab"[i % 4 // 2]) for i in range(n)]
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "row_id string, x double, z double, y string"
    df, model = spark.createDataFrame(rows, schema).mapInArrow(passed, schema), _Counted(spark)
    found = L.permutation_importance(model, df, "row_id", features, "y", ["a", "b"], repeats, seed).collect()
    assert read.value <= 2 * n  # for the sums of the buckets and for the rows
    assert model.scored.value == n * (1 + repeats * len(features))

    ranked = sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}:{seed - 1}".encode()).hexdigest())
    accuracy = lambda pairs: sum(_guess(x, z) == {"a": 0.0, "b": 1.0}.get(y, 2.0) for x, z, y in pairs) / n
    base, lost = accuracy(r[1:] for r in ranked), {f: 0.0 for f in features}
    for r in range(repeats):
        places = spark.range(n).select("id", permuted_position(F.col("id"), F.lit(n).cast("long"), seed + r).alias("p")).collect()
        donor = {p["p"]: ranked[p["id"]] for p in places}
        lost["x"] += (base - accuracy((donor[i][1], z, y) for i, (_, _, z, y) in enumerate(ranked))) / repeats
        lost["z"] += (base - accuracy((x, donor[i][2], y) for i, (_, x, _, y) in enumerate(ranked))) / repeats
    assert {r["feature"]: r["importance"] for r in found} == pytest.approx(lost, abs=1e-12) and any(lost.values())


def test_values_that_are_missing_are_shuffled_too(spark):
    rows = spark.createDataFrame([(str(i), None if i % 2 else 1.0, "a" if i % 2 else "b") for i in range(40)], "row_id string, x double, y string")

    class Missing:
        def transform(self, df):
            return df.withColumn("prediction", F.when(F.isnan(vector_to_array("features")[0]), 0.0).otherwise(1.0))

    got = L.permutation_importance(Missing(), rows, "row_id", ["x"], "y", ["a", "b"]).collect()
    assert [r["feature"] for r in got] == ["x"] and 0.3 < got[0]["importance"] < 0.7  # all right before, about half after
