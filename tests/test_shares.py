"""Fits spread over the cluster: weights go to the rows, and shares of rows have a bounded size."""

from pyspark.sql import functions as F

from tracewarden.operators import learners as L
from tracewarden.operators.audit import key_pads
from tracewarden.operators.distributed import pin
from tracewarden.plans import evidence_queries
from tracewarden.sources import tables
from tracewarden.sources.tables import bounded_shares


def test_fitting_rows_are_not_dealt_by_class(spark):
    rows = spark.range(0, 400, 1, 8).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the size of a large table's aggregate is not known either
    try:
        fit = L.fitting_rows(rows, ["x"], "y", ["a", "b"])
        assert fit.select(F.spark_partition_id()).distinct().count() == 8
        assert {r["y"]: round(r["w"], 6) for r in fit.groupBy("y").agg(F.sum("weight").alias("w")).collect()} == {"a": 200.0, "b": 200.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_shares_have_a_bounded_size(spark):
    rows = spark.range(0, 3000, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    most = 3000 // (3 * cores)
    dealt = bounded_shares(rows, most)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 3 * cores and max(sizes) <= 2 * most
    assert bounded_shares(rows, 3000) is rows


def test_spread_deals_long_splits_to_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 400_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).write.parquet(path)
    monkeypatch.setattr(tables, "SHARE_BYTES", 1 << 20)
    dealt = tables.spread(spark.read.parquet(path))
    assert dealt.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert dealt.count() == 400_000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_beside_a_pinned_column_reaches_the_scan(spark):
    df = pin(spark.range(10).withColumns({"digest": F.sha2(F.col("id").cast("string"), 256), "unread": F.md5(F.col("id").cast("string"))}), ["digest"])
    plan = _plan(df.where("id % 3 = 0 and digest like 'a%'").select("id", "digest"))
    assert plan.index("Generate") < plan.index("% 3") and plan.index("LIKE" if "LIKE" in plan else "StartsWith") < plan.index("Generate")
    assert "md5" not in plan
    assert df.where("id % 3 = 0").count() == 4


def test_a_put_builds_every_payload_once(spark, data):
    plan = _plan(evidence_queries.evidence_put(spark, data))
    assert plan.count("Relation [") == 2  # what is put, and what is held
    assert [r for r in plan.splitlines() if "Aggregate" in r and "payload" in r] == []  # payloads are not moved to tell addresses apart


def test_key_pads_translate_a_key_once(spark):
    plan = _plan(key_pads(spark.createDataFrame([("a", "00ff" * 16)], "agent_id string, key_hex string")))
    assert "translate(" in plan and "concat(translate(" not in plan  # not once for each byte


def _many(spark, shares):
    """20 rows a share; the label follows x, z is noise."""
    return spark.range(0, 20 * shares, 1, shares).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("y"))


def test_short_shares_are_put_together_without_moving_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = _many(spark, 8 * cores)
    dealt = bounded_shares(rows, 60)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 160 * cores and cores < len(sizes) < 4 * cores and max(sizes) <= 60
    assert "Exchange" not in dealt._jdf.queryExecution().executedPlan().toString()


def _rows_read(spark, run):
    """Rows of ``_many`` made while ``run`` takes them for training rows that were dealt out."""
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    train = _many(spark, 8).mapInArrow(passed, "x double, z double, y string").repartition(16)
    return run(train), made.value


def test_a_forest_reads_its_table_once(spark):
    model, read = _rows_read(spark, lambda train: L.fit_forest(train, ["x", "z"], "y", ["a", "b"]))
    assert read == 160 and model.getNumTrees == 20
    rows, read = _rows_read(spark, lambda train: L.feature_importance(train, ["x", "z"], "y", ["a", "b"]).collect())
    assert read == 160 and max(rows, key=lambda r: r["importance"])["feature"] == "x"
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_selected_and_full_read_their_rows_once_each_and_the_test_rows_in_one_pass(spark):
    test = _many(spark, 2).unionByName(spark.createDataFrame([(1.0, 1.0, None), (1.0, 1.0, "c")], "x double, z double, y string"))
    out, read = _rows_read(spark, lambda train: L.selected_vs_full(train, test, ["z"], ["x", "z"], "y", ["a", "b"]))
    assert read == 2 * 160
    assert _plan(out).count("Range (") == 1
    got = {r["class"]: r for r in out.collect()}
    assert out.columns == ["class", "full", "selected", "delta"] and set(got) == {"a", "b"}
    # x = 1 is class a, so the rows of unknown class are predicted as a
    n = {c: test.where(F.col("y") == c).count() for c in "ab"}
    assert got["a"]["full"] == 2 * n["a"] / (2 * n["a"] + 2) and got["b"]["full"] == 1.0
    assert all(r["delta"] == r["selected"] - r["full"] for r in got.values()) and got["b"]["selected"] < 1.0
