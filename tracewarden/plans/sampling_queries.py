"""Exact samples by hash rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .profile_queries import _SPLIT, split_events

_HASH = "sha256(row_id::VARCHAR || ':42')"
_RANKED = f"SELECT row_id, category, row_number() OVER (PARTITION BY category ORDER BY {_HASH}) AS rk, count(*) OVER (PARTITION BY category) AS n, count(*) OVER () AS total FROM flow"


def _rows(spark, sf):
    return B.flow(spark, sf).select("row_id", "category")


@query("sample_n", with_ctes(f"SELECT row_id, category FROM flow ORDER BY {_HASH} LIMIT 700", "flow"))
def sample_n(spark, sf):
    return S.sample_n(_rows(spark, sf), "row_id", 700)


@query("stratified_cap", with_ctes(f"SELECT row_id, category FROM ({_RANKED}) WHERE rk <= 1000 // 4", "flow"))
def stratified_cap(spark, sf):
    return S.stratified_cap(_rows(spark, sf), "row_id", "category", 1000)


@query("class_cap", with_ctes(f"SELECT row_id, category FROM ({_RANKED}) WHERE rk <= 2500", "flow"))
def class_cap(spark, sf):
    return S.class_cap(_rows(spark, sf), "row_id", "category", 2500)


@query("stratified_prop", with_ctes(
    f"SELECT row_id, category FROM ({_RANKED}) WHERE rk <= greatest(1, round_even(n * 900::DOUBLE / total, 0))", "flow"))
def stratified_prop(spark, sf):
    return S.stratified_prop(_rows(spark, sf), "row_id", "category", 900)


@query("downsample_train", f"""WITH {_SPLIT},
r AS (SELECT event_id, event_type, split, row_number() OVER (PARTITION BY split, event_type IN ('view', 'click') ORDER BY sha256(event_id::VARCHAR || ':42')) AS rk,
  count(*) OVER (PARTITION BY split, event_type IN ('view', 'click')) AS n FROM parts)
SELECT event_id, event_type, split FROM r WHERE NOT (split = 'train' AND event_type IN ('view', 'click')) OR rk <= round_even(n * 0.09::DOUBLE, 0)""")
def downsample_train(spark, sf):
    parts = split_events(spark, sf).select("event_id", "event_type", "split")
    return S.downsample_benign(parts, "event_id", "split", F.col("event_type").isin("view", "click"))


# more Bot rows are wanted than exist, so other attack classes take over, in turn
@query("quota_sample", with_ctes(f"""SELECT category, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM (
  SELECT *, CASE category WHEN 'Benign' THEN 100 WHEN 'Bot' THEN n_bot WHEN 'DDoS' THEN 50 + (n_short + 1) // 2 ELSE 50 + n_short // 2 END AS quota FROM (
    SELECT *, (SELECT count(*) FROM flow WHERE category = 'Bot') AS n_bot, 11 AS n_short FROM ({_RANKED})))
  WHERE rk <= quota GROUP BY category""", "flow"))
def quota_sample(spark, sf):
    f = _rows(spark, sf)
    bots = f.where("category = 'Bot'").count()
    wanted = {"Benign": 100, "DDoS": 50, "Bot": bots + 11, "Infiltration": 50}
    return S.quota_sample(f, "row_id", "category", wanted).groupBy("category").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


_DRAW = "CAST('0x' || substr(sha256(event_id::VARCHAR || ':42:{}'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0"


@query("replay_resample", with_ctes("", "unhashed").rstrip() + f""",
pool AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY row_id) - 1 AS slot, count(*) OVER (PARTITION BY verdict) AS n FROM unhashed),
d AS (SELECT event_id AS i, CASE WHEN {_DRAW.format('class')} < 0.25 THEN 'ANOMALY' ELSE 'NORMAL' END AS v, {_DRAW.format('slot')} AS u FROM events)
SELECT i AS draw, p.event_id AS source_event_id, p.threat_class, 'i-load-' || lpad((i % 500)::VARCHAR, 6, '0') AS cloud_resource_id
FROM d JOIN pool p ON p.verdict = d.v AND p.slot = floor(d.u * p.n)""")
def replay_resample(spark, sf):
    draws = B.flow(spark, sf).select(F.col("row_id").alias("draw"))
    out = S.replay_resample(B.alerts(spark, sf), "row_id", draws, "draw", 0.25, 500)
    return out.select("draw", "source_event_id", "threat_class", "cloud_resource_id")
