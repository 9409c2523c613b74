import math

import pytest
from pyspark.sql import functions as F

from netsift.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, bits", [("", 0.0), ("a", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("abcd", 2.0)])
def test_entropy(spark, text, bits):
    assert one(spark, S.shannon_entropy("q"), q=text) == pytest.approx(bits)


@pytest.mark.parametrize("name, has", [("example.com", False), ("a.example.com", True), ("example.co.uk", False), ("x.example.co.uk", True), ("", False), (None, False)])
def test_subdomain(spark, name, has):
    assert one(spark, S.has_subdomain(F.col("q").cast("string")), q=name) is has


def test_ramp_clips_and_keeps_null(spark):
    assert [one(spark, S.ramp("v", 3.0, 5.0), v=v) for v in (1.0, 3.0, 4.0, 5.0, 9.0)] == [0, 0, 0.5, 1, 1]
    assert spark.sql("select cast(null as double) v").select(S.ramp("v", 3.0, 5.0).alias("x")).first().x is None


def test_thresholds(spark):
    assert one(spark, S.min_threshold_score("v", 20), v=10) == 0.5
    assert one(spark, S.min_threshold_score("v", 20), v=40) == 1
    assert one(spark, S.max_threshold_score("v", 0.1), v=0.05) == pytest.approx(0.5)
    assert one(spark, S.max_threshold_score("v", 0.1), v=0.2) == 0


def test_periodicity(spark):
    assert one(spark, S.jitter_pct("m", "s"), m=0.0, s=0.0) == 0
    assert one(spark, S.periodicity_cv("m", "s"), m=100.0, s=25.0) == 0.75
    assert one(spark, S.periodicity_linear("j"), j=25.0) == 0.5


def test_names_and_bands(spark):
    assert [one(spark, S.protocol_name("p"), p=p) for p in (6, 17, 1, 99)] == ["TCP", "UDP", "ICMP", "UNKNOWN"]
    assert [one(spark, S.ddos_severity_band("c"), c=c) for c in (0.95, 0.7, 0.4, 0.1, 0.0)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    assert [one(spark, S.node_type("t"), t=t) for t in ("10.0.4.0/24", "1.2.3.4", "evil.example")] == ["EXTERNAL_IP", "EXTERNAL_IP", "DOMAIN"]
    assert [one(spark, S.scan_type("a", "b"), a=a, b=b) for a, b in ((10, 1), (1, 5), (5, 5), (1, 1))] == ["HORIZONTAL", "VERTICAL", "BROAD", "NONE"]


def test_times(spark):
    assert one(spark, S.epoch_to_iso("u"), u=1704067200000001) == "2024-01-01T00:00:00.000001+00:00"
    assert one(spark, S.iso_to_ts("t"), t="nonsense") is None
    assert one(spark, S.non_negative_finite("v"), v=float("nan")) == 0
    assert one(spark, S.anomaly_confidence("v", "b"), v=0.0, b=True) == 0.5


def test_sql_functions(spark):
    S.register_sql(spark)
    row = spark.sql("select shannon_entropy('abcd') e, ramp(4, 3, 5) r, has_subdomain('a.example.com') s").first()
    assert math.isclose(row.e, 2) and row.r == 0.5 and row.s
