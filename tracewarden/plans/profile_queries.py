"""Profiles, statistics, ordering and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import profile as P
from ..operators import sets
from ..operators.selection import feature_rank, stump_screen
from ..sources.tables import spread, table
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .rounding import rounded

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("class_distribution", with_ctes("""
SELECT attack AS label, count(*) AS n,
  round((SELECT count(*) FROM flow WHERE attack = 'view')::DOUBLE / count(*), 6) AS benign_ratio FROM flow GROUP BY attack""", "flow"))
def class_distribution(spark, sf):
    return rounded(P.class_distribution(B.flow(spark, sf), "attack", ["view"]))


def _profile_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR isnan({c}::DOUBLE)) AS n_missing, "
        f"count(*) FILTER (isinf({c}::DOUBLE)) AS n_infinite, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, "
        f"min({c}) = max({c}) AS zero_variance FROM lines" for c in columns)


@query("column_profile", with_ctes(_profile_sql(B.LINE_FEATURES), "lines"))
def column_profile(spark, sf):
    return P.column_profile(B.lines(spark, sf), B.LINE_FEATURES)


@query("zero_variance", with_ctes(
    f"SELECT column_name AS feature FROM ({_profile_sql(B.LINE_FEATURES)}) WHERE zero_variance", "lines"))
def zero_variance(spark, sf):
    return P.zero_variance(B.lines(spark, sf), B.LINE_FEATURES)


_SUMMARY = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "props": "string"}


@query("column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, "
    f"min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM events" for c, t in _SUMMARY.items()))
def column_summary(spark, sf):
    return P.column_summary(table(spark, sf, "events"), list(_SUMMARY))


@query("duplicate_count", """WITH raw AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0)
SELECT (SELECT count(*) FROM raw) AS n_rows, count(*) AS n_distinct, (SELECT count(*) FROM raw) - count(*) AS n_duplicates FROM (SELECT DISTINCT * FROM raw)""")
def duplicate_count(spark, sf):
    """Copies of whole rows: the table with some of its orders delivered again."""
    lines = table(spark, sf, "lineitem")
    raw = lines.unionByName(lines.where("l_orderkey % 7 = 0"))
    return P.duplicate_count(raw, raw.columns)


# the capture with some rows delivered again, whole but for their id
_COPIES = 1_000_000_000
_RAW = f"""raw AS (SELECT * FROM events
  UNION ALL SELECT event_id + {_COPIES} AS event_id, ts, user_id, event_type, value, props FROM events WHERE event_id % 15 = 3)"""
_DEDUPED = f"""{_RAW}, kept AS (
  SELECT min(event_id) AS event_id, ts, user_id, event_type, value, props FROM raw GROUP BY ts, user_id, event_type, value, props)"""


def _raw(spark, sf):
    events = table(spark, sf, "events")
    return events.unionByName(events.where("event_id % 15 = 3").withColumn("event_id", F.col("event_id") + _COPIES))


def _deduped(spark, sf):
    return O.keep_first(_raw(spark, sf), "event_id")


@query("distinct_rows", f"WITH {_RAW} SELECT DISTINCT epoch_us(ts) AS ts_us, user_id, event_type, round(value, 6) AS value, props FROM raw")
def distinct_rows(spark, sf):
    rows = O.distinct_rows(_raw(spark, sf).drop("event_id"))
    return rows.select(B.micros(F.col("ts")).alias("ts_us"), "user_id", "event_type", F.round("value", 6).alias("value"), "props")


@query("dedup_keep_first", f"WITH {_DEDUPED} SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, round(value, 6) AS value, props FROM kept")
def dedup_keep_first(spark, sf):
    rows = _deduped(spark, sf)
    return rows.select("event_id", B.micros(F.col("ts")).alias("ts_us"), "user_id", "event_type", F.round("value", 6).alias("value"), "props")


@query("row_position", f"WITH {_DEDUPED} SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM kept")
def row_position(spark, sf):
    return O.row_position(_deduped(spark, sf), "event_id").select("event_id", "position")


_SPLIT = f"""{_DEDUPED},
pos AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM kept),
parts AS (SELECT event_id, ts, user_id, event_type, value, props, CASE WHEN p < floor(n * 0.6::DOUBLE) THEN 'train'
   WHEN p < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pos)"""


def split_events(spark, sf):
    return O.positional_split(_deduped(spark, sf), "event_id")


@query("positional_split", f"WITH {_SPLIT} SELECT event_id, split FROM parts")
def positional_split(spark, sf):
    return split_events(spark, sf).select("event_id", "split")


@query("split_counts", f"WITH {_SPLIT} SELECT split, event_type, count(*) AS n FROM parts GROUP BY split, event_type")
def split_counts(spark, sf):
    return P.split_counts(split_events(spark, sf), "split", "event_type")


@query("split_class_diff", f"""WITH {_SPLIT}, c AS (SELECT split, event_type || '-' || regexp_extract(props, '[0-9]+') AS class FROM parts)
SELECT s.split, u.class FROM (SELECT DISTINCT split FROM c) s CROSS JOIN (SELECT DISTINCT class FROM c) u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.split = s.split AND c.class = u.class)""")
def split_class_diff(spark, sf):
    # a fixed set of some hundred labels, so that a small split misses some
    label = F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k"))
    return sets.missing_classes(split_events(spark, sf).withColumn("label", label), "split", "label")


@query("label_set_diff", """
SELECT value, CASE WHEN max(side) = 'left' THEN 'left_only' ELSE 'right_only' END AS side FROM (
  SELECT DISTINCT c_mktsegment AS value, 'left' AS side FROM customer
  UNION ALL SELECT DISTINCT o_orderpriority, 'right' FROM orders) GROUP BY value HAVING count(*) = 1""")
def label_set_diff(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("v"))
    return sets.symmetric_difference(a, b, "v")


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.95) AS p95, "
    f"min({c}) AS min, max({c}) AS max FROM lineitem" for c in _NUM)


@query("feature_stats", f"SELECT feature, round(median, 6) AS median, round(p05, 6) AS p05, round(p95, 6) AS p95, min, max FROM ({_STATS})")
def feature_stats(spark, sf):
    return rounded(P.feature_stats(spread(table(spark, sf, "lineitem")), _NUM))


@query("class_medians", "SELECT l_returnflag, feature, round(median, 6) AS median FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS feature, quantile_cont({c}, 0.5) AS median FROM lineitem GROUP BY l_returnflag" for c in _NUM) + ")")
def class_medians(spark, sf):
    return rounded(P.class_medians(spread(table(spark, sf, "lineitem")), "l_returnflag", _NUM))


@query("variant_counts", with_ctes("SELECT category, attack, count(*) AS n FROM flow GROUP BY category, attack", "flow"))
def variant_counts(spark, sf):
    return P.variant_counts(B.flow(spark, sf), "category", "attack")


_KEPT = B.LINE_FEATURES[:-1]
_PAIRS = [(a, b) for i, a in enumerate(_KEPT) for b in _KEPT[i + 1:]]
_PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, corr({a}, {b}) AS correlation, var_samp({a}) AS va, var_samp({b}) AS vb "
    "FROM lines WHERE split = 'train'" for a, b in _PAIRS)


def _train_lines(spark, sf):
    return B.lines(spark, sf).where("split = 'train'")


@query("correlation_pairs", with_ctes(
    f"SELECT left_feature, right_feature, round(correlation, 6) AS correlation FROM ({_PAIR_SQL})", "lines"))
def correlation_pairs(spark, sf):
    return rounded(P.correlation_pairs(_train_lines(spark, sf), _KEPT))


@query("correlation_drop", with_ctes(
    f"SELECT DISTINCT CASE WHEN va < vb THEN left_feature ELSE right_feature END AS feature FROM ({_PAIR_SQL}) WHERE abs(correlation) > 0.95", "lines"))
def correlation_drop(spark, sf):
    return P.correlation_drop(_train_lines(spark, sf), _KEPT)


def _stump_sql(features):
    parts = " UNION ALL ".join(f"SELECT split, category, '{f}' AS feature, {f} AS value FROM lines WHERE split <> 'test'" for f in features)
    k = B.LINE_CLASSES
    cnt = ", ".join(f"count(*) FILTER (category = '{c}') AS c{i}" for i, c in enumerate(k))
    cum = ", ".join(f"sum(c{i}) OVER o AS l{i}, sum(c{i}) OVER (PARTITION BY feature) AS t{i}" for i in range(3))
    return f"""
long AS ({parts}),
g AS (SELECT split, feature, value, {cnt} FROM long GROUP BY split, feature, value),
c AS (SELECT *, {cum}, lead(value) OVER o AS nxt FROM g WHERE split = 'train'
   WINDOW o AS (PARTITION BY feature ORDER BY value)),
d AS (SELECT feature, value, nxt, l0::DOUBLE AS l0, l1::DOUBLE AS l1, l2::DOUBLE AS l2,
   (t0 - l0)::DOUBLE AS r0, (t1 - l1)::DOUBLE AS r1, (t2 - l2)::DOUBLE AS r2 FROM c),
p AS (SELECT *, CASE WHEN r0 + r1 + r2 > 0 THEN (l0*l0 + l1*l1 + l2*l2) / (l0 + l1 + l2) + (r0*r0 + r1*r1 + r2*r2) / (r0 + r1 + r2) ELSE -1.0 END AS purity FROM d),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY purity DESC, value) AS rn FROM p) WHERE rn = 1),
s AS (SELECT feature, (value + nxt) / 2.0 AS threshold,
   CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'A' WHEN l1 >= l2 THEN 'N' ELSE 'R' END AS lc,
   CASE WHEN nxt IS NULL THEN CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'A' WHEN l1 >= l2 THEN 'N' ELSE 'R' END
        WHEN r0 >= r1 AND r0 >= r2 THEN 'A' WHEN r1 >= r2 THEN 'N' ELSE 'R' END AS rc FROM b),
v AS (SELECT feature, category, CASE WHEN threshold IS NULL OR value <= threshold THEN lc ELSE rc END AS pred
   FROM long JOIN s USING (feature) WHERE split = 'val'),
f AS (SELECT v.feature, k.c, 2.0 * count(*) FILTER (category = k.c AND pred = k.c) / nullif(count(*) FILTER (category = k.c) + count(*) FILTER (pred = k.c), 0) AS f1
   FROM v, (SELECT unnest(['A', 'N', 'R']) AS c) k GROUP BY v.feature, k.c)"""


_SCREENED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "const_feature"]


@query("stump_screen", with_ctes("", "lines").rstrip() + "," + _stump_sql(_SCREENED) + """
SELECT feature, round(avg(f1), 6) AS solo_macro_f1, avg(f1) > 0.9 AS flagged FROM f GROUP BY feature""")
def stump(spark, sf):
    lines = B.lines(spark, sf)
    return rounded(stump_screen(
        lines.where("split = 'train'"), lines.where("split = 'val'"), _SCREENED, "category", B.LINE_CLASSES))


@query("feature_rank", with_ctes("", "lines").rstrip() + "," + _stump_sql(_SCREENED) + """
SELECT feature, round(avg(f1), 6) AS solo_macro_f1 FROM f GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 3""")
def rank_features(spark, sf):
    return feature_rank(stump(spark, sf).select("feature", "solo_macro_f1"), "solo_macro_f1", 3)


@query("tail_n", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def tail(spark, sf):
    return O.tail_n(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 20)
