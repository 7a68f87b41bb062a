"""Fingerprints (FIXTURES F2) and evidence ids."""

from pyspark.sql import functions as F

from vigil.functions import ids


def _fp(spark, rows):
    df = spark.createDataFrame(rows, "c string, ns string, w array<string>, s string")
    return [r.f for r in df.select(ids.fingerprint("c", "ns", "w", F.col("s")).alias("f")).collect()]


def test_fingerprint_invariants(spark):
    base = ("http_error_rate", "default", ["order-api", "gateway"], None)
    out = _fp(spark, [
        base,
        ("http_error_rate", "default", ["gateway", "order-api", "gateway", " order-api "], None),
        ("dependency_latency", "default", ["order-api", "gateway"], None),
        ("http_error_rate", "other", ["order-api", "gateway"], None),
        ("http_error_rate", "default", ["order-api"], None),
        ("http_error_rate", "default", ["order-api", "gateway"], "abc"),
        ("http_error_rate", "default", ["order-api", "gateway", "", None], "  "),
    ])
    assert len(out[0]) == 20
    assert out[0] == out[1] == out[6]
    assert len(set(out[:6])) == 5


def test_fingerprint_matches_reference_layout(spark):
    import hashlib

    (f,) = _fp(spark, [("out_of_memory", "default", ["b", "a"], "OOMKilled")])
    assert f == hashlib.sha256(b"out_of_memory|default|a,b|OOMKilled").hexdigest()[:20]


def test_evidence_id(spark):
    import hashlib

    df = spark.createDataFrame([("h1", None)], "h string, w string")
    (r,) = df.select(ids.evidence_id("LogSignature", "loki", "h", "w").alias("i")).collect()
    assert r.i == "sig_" + hashlib.sha256(b"LogSignature|loki|h1|").hexdigest()[:12]
