import hashlib
import hmac
import json
import math
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from tracewarden import schema as S
from tracewarden.functions import digests as D
from tracewarden.functions import text as X
from tracewarden.functions.canonical import digest_claim_holds, with_canonical_json, with_payload_digest

# fixed values of the producer's digest: three alerts and the all-null one
VECTORS = [
    (("fc2a5583-5272-5211-8d62-71c520c20b80", "1.0.0", "2026-09-17T20:21:42.768+00:00", "ANOMALY", "BruteForce", 1.0,
      "flat_tuned_tau-fa8d2667cc39", "13.58.98.64", 40756, "172.31.69.25", 22, "cloud-res-735a5c8b1a84",
      "5441bd0c8d8d8e52410fef2550e68f01763f90103cbf1599027f248a05c1639a"),
     "9f0a7d3b7808607acb02eea90c3f0ea66673f85df0f1eb95c01ddec931820ff4"),
    (("ff68cbe3-05d1-588e-a336-67abaf696ec7", "1.0.0", "2026-09-17T20:21:42.768+00:00", "NORMAL", "Benign", 0.095303,
      "flat_tuned_tau-fa8d2667cc39", "5.101.40.43", 57052, "172.31.69.16", 3389, "cloud-res-67e77213995d",
      "c0fd64b22209a8f68cce1139c59f5f46a156f922448ed5a4c73c365fb0408556"),
     "17d5f90a0beda1f64c26ccb45ae1728a5deaae79a635eed65983f8ea2a5326f5"),
    (("7d6181c3-be42-5f23-9683-b7a652721b63", "1.0.0", "2026-09-17T20:21:42.768+00:00", "ANOMALY", "DoS", 1.0,
      "flat_tuned_tau-fa8d2667cc39", "18.219.193.20", 34878, "172.31.69.25", 80, "cloud-res-735a5c8b1a84",
      "9acfcc7dca8fe22d20798a9cca1476507c61fc9fbe3f53a6dbcf6b03ecc75238"),
     "9335576050f04b42de1bd2190336a4c4ccf7a21a7d081e9784412307cf7fb658"),
    ((None,) * 13, "99efa3c2314ff91e724674be9279ee6c0f78be75a6989b67264c4fbe1bedd945"),
]
ALERT_DDL = (
    "event_id string, schema_version string, timestamp string, verdict string, threat_class string, confidence double, "
    "model_version string, src_ip string, src_port bigint, dst_ip string, dst_port bigint, cloud_resource_id string, feature_digest string"
)


def test_event_hash_vectors(spark):
    df = spark.createDataFrame([v for v, _ in VECTORS], ALERT_DDL)
    got = [r[0] for r in df.select(D.sha256_hex(D.alert_canonical_string())).collect()]
    assert got == [h for _, h in VECTORS]


def test_resource_id_matches_the_vectors(spark):
    df = spark.createDataFrame([("172.31.69.25",), (None,)], "ip string")
    assert [r[0] for r in df.select(D.resource_id(F.col("ip"))).collect()] == ["cloud-res-735a5c8b1a84", None]


# fixed values of the canonical JSON form
def test_canonical_json_vectors(spark):
    df = spark.range(1).select(
        F.struct(F.lit(2).alias("b"), F.lit(1).alias("a")).alias("two"),
        F.struct(F.lit(None).cast("string").alias("z"), F.struct(F.lit(1).alias("y"), F.lit(-7).alias("x")).alias("a"),
                 F.array(F.lit(3), F.lit(1), F.lit(2)).alias("m")).alias("nested"),
        F.struct(F.lit(0.9975).alias("conf"), F.lit(2.0).alias("whole"), F.lit(-0.5).alias("neg"), F.lit(1e-6).alias("tiny")).alias("floats"),
        F.struct(F.lit('line1\nline2\ttabbed "quoted" back\\slash /slash/ café').alias("note")).alias("escaping"),
        F.struct(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("contribution")) for f, c in
                           (("Rate", 0.41), ("Header_Length", 0.22), ("Tot_size", -0.05))]).alias("feature_attributions")).alias("order"),
    )
    want = {
        "two": "43258cff783fe7036d8a43033f830adfc60ec037382473548ac742b888292777",
        "nested": "9abfe483ebecd84f850c4d15a994fdb20c92613c0bbeb6a43c9647b6b21ee1d6",
        "floats": "e67b5dd5a34ea8176941d1cc3f9c88264f8b316f3884b4dba5f0bb825b4e3de4",
        "escaping": "083223d57e4f74bc9795bdf979d5bbc7ec9757e4345dc7f28c3a36e9dc74a977",
        "order": "4198682780ac952c35c36348cd7bb547348421d869ee0b69bab7a5d6a1294308",
    }
    for floats in ("exact", "six"):
        for name, digest in want.items():
            text = with_canonical_json(df, name, "t", floats=floats).first()["t"]
            assert hashlib.sha256(text.encode()).hexdigest() == digest, (floats, name, text)


BOUNDARY = [
    0.0, 6.0, 1480.0, 1500.0, 0.412, 16251.95, 0.0001, 1e-05, 8.135997203703995e-05, 0.9997655153274536, 0.303016, 1e15,
    1234567890123456.0, 1e16, 1.5e16, 2e13, -6.0, -0.5, 5e-324, 1.7976931348623157e308, 5.684341886080802e-14, 8.41e21, 1e23,
]


def test_exact_float_text_equals_repr(spark):
    rng = random.Random(7)
    values = BOUNDARY + [-0.0, 1e-300, 1e300] + [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(2000)]
    values += [v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)) if math.isfinite(v)]
    values += [float(2 ** i) for i in range(1023)] + [1000000000000000.1, 9007199254740993.0, 123456789012345.67]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("s", F.struct("v"))
    got = [r["t"] for r in with_canonical_json(df, "s", "t").collect()]
    assert got == ['{"v":%s}' % repr(v) for v in values]


def test_native_float_text_is_exact_for_six_places(spark):
    rng = random.Random(8)
    values = [i / 1e6 for i in range(200)] + [-i / 1e6 for i in range(1, 130)]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-5, 15), 6) for _ in range(5000)] + [0.0, -0.0, 1.0, 999999999.0, 1e9, 1.7e13, 1.16e13, 1e16, 2.5e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", X.repr6(F.col("v")).alias("r"), X.fixed6(F.col("v")).alias("f")).collect()
    for r in rows:
        assert r["r"] == repr(r["v"])
        assert abs(r["v"]) > 1e9 or r["f"] == f"{r['v']:.6f}"


def test_fixed6_exact_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.9997655,), (None,)], "v double")
    assert [r[0] for r in df.select(X.fixed6_exact("v")).collect()] == ["0.999765", None]


def test_nan_has_no_canonical_form(spark):
    df = spark.createDataFrame([(float("nan"),)], "v double").withColumn("s", F.struct("v"))
    with pytest.raises(Exception, match="no canonical form"):
        with_canonical_json(df, "s", "t").collect()


def test_json_string_escapes_every_control_character(spark):
    text = "".join(map(chr, range(32))) + '"\\/é😀\x7f'
    got = spark.createDataFrame([(text,)], "v string").select(X.json_string(F.col("v"))).first()[0]
    assert got == json.dumps(text, ensure_ascii=False)


def test_payload_digest_ignores_its_own_member_and_optional_nulls(spark):
    event = {
        "contract_version": "2.0.0", "event_id": "5f2c9b3e-7d0a-4a41-9c2a-1b6a2e7d5f00", "timestamp": "2026-09-15T18:04:12.501Z",
        "verdict": "ATTACK", "threat_category": "Infiltration", "severity": "critical", "calibrated_confidence": 0.303016,
        "calibration": {"is_calibrated": True, "method": "isotonic", "expected_calibration_error": 8.135997203703995e-05},
        "source_address": "10.0.0.7:44321", "destination_address": None, "resource_id": "cloud-res-9f2b1c4d8e0a",
        "triggering_features": {"LONGEST_FLOW_PKT": 1500.0, "IN_BYTES": 1480.0},
        "model": {"model_id": "m", "model_digest": "a" * 64, "version_label": "v"},
        "feature_attributions": [{"feature": "IN_BYTES", "contribution": 0.412}], "detection_contract": None,
        "inference_latency_ms": 0.42, "payload_digest": "x" * 64,
    }
    df = spark.createDataFrame([(event,)], f"event {S.EVIDENCE_EVENT.simpleString()}")
    kept = {k: v for k, v in event.items() if k not in ("payload_digest", "detection_contract")}
    want = hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    out = with_payload_digest(df, "event", "d", S.EVIDENCE_OPTIONAL)
    assert out.first()["d"] == want
    claims = out.select(
        digest_claim_holds(F.upper("d"), F.col("d")), digest_claim_holds(F.lit("ab"), F.col("d")),
        digest_claim_holds(F.lit(None).cast("string"), F.col("d"))).first()
    assert list(claims) == [True, False, False]


def test_uuid5_hmac_and_addresses(spark):
    rng = random.Random(1)
    names = [f"alert/{i}" for i in range(50)]
    keys = [rng.randbytes(32).hex() for _ in names]
    df = spark.createDataFrame(list(zip(names, keys)), "n string, k string")
    inner, outer = D.hmac_pads(F.col("k"))
    rows = df.select("n", "k", D.uuid5(F.col("n")).alias("u"), D.hmac_sha256(inner, outer, F.col("n")).alias("h")).collect()
    for r in rows:
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"]))
        assert r["h"] == hmac.new(bytes.fromhex(r["k"]), r["n"].encode(), hashlib.sha256).hexdigest()
    nobody = spark.createDataFrame([(None, "x")], "k string, n string")
    assert nobody.select(D.hmac_sha256(*D.hmac_pads(F.col("k")), F.col("n"))).first()[0] is None
    digest = "ab" * 32
    given = [(digest,), ("sha256:" + digest.upper(),), ("sha256:abc",), ("zz" * 32,)]
    got = [r[0] for r in spark.createDataFrame(given, "a string").select(D.parse_address(F.col("a"))).collect()]
    assert got == [digest, digest, None, None]
    pairs = spark.createDataFrame([("1.2.3.4", 5), ("1.2.3.4", None), (None, 5)], "ip string, port int")
    assert [r[0] for r in pairs.select(D.format_address(F.col("ip"), F.col("port"))).collect()] == ["1.2.3.4:5", "1.2.3.4", None]
