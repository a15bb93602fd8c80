"""Label mapping, masking, coercion, imputation and alert vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import format_address, parse_address, resource_id, uuid5
from ..functions.text import parse_rfc3339, rfc3339
from ..operators import cleaning as L
from ..sources.tables import table
from . import bindings as B
from .bindings import with_ctes
from .catalog import query
from .profile_queries import _SPLIT, split_events
from .rounding import rounded

_PARTIAL = {k: v for k, v in B.EVENT_MAP.items() if k != "error"}
_CASE = "CASE attack WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'Benign' WHEN 'signup' THEN 'Bot' WHEN 'purchase' THEN 'DDoS' END"


@query("label_map", with_ctes(f"SELECT row_id, attack, {_CASE} AS mapped, category = 'Benign' AS benign FROM flow", "flow"))
def label_map(spark, sf):
    f = L.map_labels(B.flow(spark, sf), "attack", "mapped", _PARTIAL)
    return f.select("row_id", "attack", "mapped", L.is_benign(F.col("category")).alias("benign"))


@query("label_unmapped", with_ctes("SELECT attack AS label, count(*) AS n FROM flow WHERE attack = 'error' GROUP BY attack", "flow"))
def label_unmapped(spark, sf):
    return L.unmapped_labels(B.flow(spark, sf), "attack", _PARTIAL)


@query("verdict", with_ctes("""
SELECT row_id, CASE WHEN pred = 'Benign' THEN 'NORMAL' ELSE 'ANOMALY' END AS producer_verdict,
  CASE WHEN pred = 'Benign' THEN 'BENIGN' ELSE 'ATTACK' END AS evidence_verdict FROM flow""", "flow"))
def verdict(spark, sf):
    pred = F.col("pred")
    return B.flow(spark, sf).select(
        "row_id", L.verdict(pred).alias("producer_verdict"), L.verdict(pred, "ATTACK", "BENIGN").alias("evidence_verdict"))


@query("severity", with_ctes("""
SELECT row_id, CASE pred WHEN 'Benign' THEN 'NONE' WHEN 'Infiltration' THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE pred WHEN 'Benign' THEN 'informational' WHEN 'Infiltration' THEN 'critical' ELSE 'high' END AS evidence_severity,
  'UNKNOWN' AS unmapped FROM flow""", "flow"))
def severity(spark, sf):
    own = L.severity(F.col("pred"))
    return B.flow(spark, sf).select(
        "row_id", own.alias("severity"), L.translate_severity(own).alias("evidence_severity"),
        L.severity(F.col("attack")).alias("unmapped"))


# infinities and large values derived from the data: price scaled out of range for some rows
_DIRTY = """dirty AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber = 1 THEN l_extendedprice * 1e10 WHEN l_linenumber = 2 THEN 'infinity'::DOUBLE
       WHEN l_linenumber = 3 THEN 'nan'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)"""


def _dirty(spark, sf):
    n = F.col("l_linenumber")
    price = (
        F.when(n == 1, F.col("l_extendedprice") * 1e10).when(n == 2, F.lit(float("inf")))
        .when(n == 3, F.lit(float("nan"))).when(n == 4, None).otherwise(F.col("l_extendedprice"))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", price.alias("price"))


@query("mask_outliers", f"""WITH {_DIRTY} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  CASE WHEN NOT isnan(price) AND abs(price) <= 2e13 THEN price END AS price FROM dirty""")
def mask_outliers(spark, sf):
    return L.mask_outliers(_dirty(spark, sf), ["price"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "price")


@query("outlier_counts", f"""WITH {_DIRTY}
SELECT 'price' AS feature, count(*) FILTER (NOT isnan(price) AND abs(price) > 2e13) AS n_masked FROM dirty
UNION ALL SELECT 'l_quantity', count(*) FILTER (abs(l_quantity) > 2e13) FROM dirty""")
def outlier_counts(spark, sf):
    return L.outlier_counts(_dirty(spark, sf), ["price", "l_quantity"])


@query("coerce_numeric", """SELECT event_id, TRY_CAST(t AS DOUBLE) AS parsed FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE CAST(user_id AS VARCHAR) || '.5' END AS t FROM events)""")
def coerce_numeric(spark, sf):
    return L.coerce_numeric(_text_numbers(spark, sf), ["parsed"])


def _text_numbers(spark, sf):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return table(spark, sf, "events").select("event_id", text.alias("parsed"))


@query("coercion_failures", "SELECT 'parsed' AS feature, count(*) FILTER (event_type = 'error') AS n_failed FROM events")
def coercion_failures(spark, sf):
    return L.coercion_failures(_text_numbers(spark, sf), ["parsed"])


_GAPS = """gaps AS (SELECT l_orderkey, l_linenumber, split, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS price FROM lines),
med AS (SELECT quantile_cont(qty, 0.5) AS mq, quantile_cont(price, 0.5) AS mp FROM gaps WHERE split = 'train')"""


def _gaps(spark, sf):
    n = F.col("l_linenumber")
    return B.lines(spark, sf).select(
        "l_orderkey", n.cast("long").alias("l_linenumber"), "split",
        F.when(n != 4, F.col("l_quantity")).alias("qty"), F.when(n != 5, F.col("l_extendedprice")).alias("price"))


@query("median_impute", with_ctes("", "lines").rstrip() + f""", {_GAPS}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, split, round(coalesce(qty, mq), 6) AS qty, round(coalesce(price, mp), 6) AS price FROM gaps, med""")
def median_impute(spark, sf):
    g = _gaps(spark, sf)
    return rounded(L.impute(g, ["qty", "price"], L.fit_medians(g, ["qty", "price"])))


@query("narrow_types", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS line_sum, sum(l_suppkey)::BIGINT AS supp_sum, "
       "'tinyint' AS line_type, true AS supp_narrowed FROM lineitem")
def narrow_types(spark, sf):
    raw = table(spark, sf, "lineitem")
    plan = L.plan_types(raw, ["l_linenumber", "l_suppkey"])
    narrow = L.narrow_types(raw, plan)
    kinds = dict(narrow.dtypes)
    return narrow.agg(
        F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("line_sum"), F.sum("l_suppkey").cast("long").alias("supp_sum"),
        F.lit(kinds["l_linenumber"]).alias("line_type"), F.lit(kinds["l_suppkey"] != "bigint").alias("supp_narrowed"))


@query("format_address", with_ctes("""
SELECT event_id, CASE WHEN src_ip IS NULL THEN NULL WHEN src_port IS NULL THEN src_ip ELSE src_ip || ':' || src_port END AS source_address,
  dst_ip || ':' || dst_port AS destination_address FROM alerts""", "alerts"))
def format_addresses(spark, sf):
    a = B.alerts(spark, sf)
    return a.select(
        "event_id", format_address(F.col("src_ip"), F.col("src_port")).alias("source_address"),
        format_address(F.col("dst_ip"), F.col("dst_port")).alias("destination_address"))


@query("resource_id", with_ctes("SELECT row_id, dst_ip, cloud_resource_id FROM unhashed", "unhashed"))
def resource_ids(spark, sf):
    return B.scored_for_alerts(spark, sf).select("row_id", "dst_ip", resource_id(F.col("dst_ip")).alias("cloud_resource_id"))


@query("uuid5", with_ctes("SELECT row_id, event_id FROM unhashed", "unhashed"))
def uuid5s(spark, sf):
    return B.flow(spark, sf).select("row_id", uuid5(F.concat(F.lit("alert/"), F.col("row_id").cast("string"))).alias("event_id"))


@query("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS written, true AS same_instant FROM events")
def rfc3339_text(spark, sf):
    e = table(spark, sf, "events").select("event_id", rfc3339(F.col("ts")).alias("written"))
    offset = F.replace("written", F.lit("Z"), F.lit("+00:00"))
    return e.withColumn("same_instant", parse_rfc3339(F.col("written")) == parse_rfc3339(offset))


@query("parse_address", with_ctes("""
SELECT event_id, CASE WHEN row_id % 4 = 3 THEN NULL ELSE feature_digest END AS digest FROM alerts""", "alerts"))
def parse_addresses(spark, sf):
    a, row = B.alerts(spark, sf), F.col("row_id")
    digest = F.col("feature_digest")
    written = (
        F.when(row % 4 == 0, digest).when(row % 4 == 1, F.concat(F.lit("sha256:"), digest))
        .when(row % 4 == 2, F.concat(F.lit("sha256:"), F.upper(digest))).otherwise(F.substring(digest, 1, 40))
    )
    return a.select("event_id", parse_address(written).alias("digest"))


@query("prepare_flows", f"""WITH {_SPLIT}, f AS (SELECT * FROM parts),
m AS (SELECT quantile_cont(value, 0.5) AS med FROM f WHERE split = 'train' AND value <= 400)
SELECT split, CASE WHEN event_type IN ('view', 'click') THEN 'Benign' WHEN event_type = 'signup' THEN 'Bot'
   WHEN event_type = 'purchase' THEN 'DDoS' ELSE 'Infiltration' END AS category, count(*) AS n,
  count(*) FILTER (value > 400) AS n_masked, round(avg(CASE WHEN value <= 400 THEN value ELSE med END), 6) AS mean_value
FROM f, m GROUP BY ALL""")
def prepare_flows(spark, sf):
    """The preparation job: first occurrences, split by position, mask, map labels, impute from train."""
    f = L.map_labels(split_events(spark, sf), "event_type", "category", B.EVENT_MAP).withColumn("masked", L.is_outlier(F.col("value"), 400.0))
    f = L.mask_outliers(f, ["value"], 400.0)
    filled = L.impute(f, ["value"], L.fit_medians(f, ["value"]))
    return rounded(filled.groupBy("split", "category").agg(
        F.count("*").alias("n"), F.count_if("masked").alias("n_masked"), F.avg("value").alias("mean_value")))
