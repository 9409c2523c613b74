from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsift.operators import correlate as C
from netsift.operators import detectors as D

CTX = "pps double, syn_ratio double, periodicity double, jitter double, observations int, ja3 string, ja4 string, sni string, alpn string"


def run(spark, name, **values):
    row = {c.split()[0]: None for c in CTX.split(", ")} | values
    return D.detect(spark.createDataFrame([row], CTX), name).first()


def test_ddos(spark):
    assert run(spark, "ddos", pps=10.0, syn_ratio=0.0).severity == "INFO"
    top = run(spark, "ddos", pps=6000.0, syn_ratio=0.9)
    assert (top.confidence, top.severity) == (1.0, "CRITICAL") and len(top.reasons) == 2
    reason = run(spark, "ddos", pps=10.0, syn_ratio=0.6)
    assert reason.score == 0 and reason.reasons == ["elevated_tcp_syn_ratio"]


def test_c2(spark):
    few = run(spark, "c2", periodicity=1.0, jitter=0.0, observations=3)
    assert few.score <= 0.4 and few.confidence <= 0.3
    assert run(spark, "c2", periodicity=1.0, jitter=0.0, observations=9).confidence == 0.85
    assert run(spark, "c2", periodicity=None, jitter=1.0, observations=9).severity == "INFO"


def test_encrypted_without_tls(spark):
    assert run(spark, "encrypted", periodicity=1.0, jitter=0.0).score == 0
    assert run(spark, "encrypted", periodicity=1.0, jitter=0.0, ja3="x").confidence == pytest.approx((0.15 + 0.7) * 0.25 * 0.85)


def test_missing_dns_features_lower_confidence_only(spark):
    schema = "entropy_mean double, query_length_mean double, nxdomain_count long, txt_record_ratio double, subdomain_count long"
    r = D.detect(spark.createDataFrame([(4.5, None, None, None, None)], schema), "dns").first()
    assert r.score == 1 and r.confidence == pytest.approx(0.3 * 0.9)


def test_unknown_input_and_duplicates(spark):
    ctx = spark.createDataFrame([("h", datetime(2024, 1, 1, tzinfo=UTC), 6000.0, 0.9)], "entity string, ts timestamp, pps double, syn_ratio double")
    rows = {r.detector: r for r in D.run_detectors(ctx).collect()}
    assert rows["ddos"].status == "ok" and rows["recon"].status == "no input" and rows["recon"].score is None
    with pytest.raises(ValueError):
        D.run_detectors(ctx, extra=(D.DetectorSpec("ddos", (), D.ddos),))


def test_fusion_and_incident(spark):
    rows = [("h", datetime(2024, 1, 1, 0, 0, tzinfo=UTC), 0, "RECON_PORT_SCAN", "RULE", 0.75, "HIGH", 0.0), ("h", datetime(2024, 1, 1, 0, 5, tzinfo=UTC), 1, "BOTNET_C2_BEACONING", "ML", 0.88, "HIGH", 0.0), ("h", datetime(2024, 1, 1, 1, 0, tzinfo=UTC), 0, "RECON_PORT_SCAN", "RULE", 0.2, "LOW", 0.0)]
    s = spark.createDataFrame(rows, "entity string, ts timestamp, detector_order int, threat_class string, detector_type string, confidence double, severity string, zscore double")
    g = C.group_signals(s, 300)
    r = {x.group_no: x for x in C.composite_risk(g).collect()}
    assert r[0].risk == 0.99 and r[0].severity == "CRITICAL" and r[1].severity == "LOW"
    i = C.build_incidents(g.withColumn("evidence", C.evidence_items(g.columns))).where("group_no = 0").first()
    assert i.stages == ["RECONNAISSANCE", "C2_ESTABLISHMENT"] and i.main_class == "BOTNET_C2_BEACONING" and i.recommended_action.startswith("Isolate")
    a = C.build_alerts(g.withColumn("reasons", F.array()), None).where("detector_order = 1").first()
    assert a.summary == "Botnet C2 Beaconing activity detected from h toward external infrastructure."


def uneven(frame):
    if (frame["pps"] < 0).any():
        raise ValueError("negative rate")
    return pd.DataFrame({"score": frame["pps"] / 100, "confidence": frame["pps"] / 200, "severity": ["LOW" if x < 50 else None for x in frame["pps"]]})


def test_python_detectors_beside_expressions(spark):
    rows = spark.createDataFrame([(1, 10.0, 0.9), (2, -1.0, 0.0), (3, 90.0, None)], "seq long, pps double, syn_ratio double").coalesce(1)
    own = D.PythonDetector("uneven", ("pps",), uneven, "UNEVEN")
    lacking = D.PythonDetector("lacking", ("nothing",), uneven)
    short = D.PythonDetector("short", ("pps",), lambda f: uneven(f.abs()).head(0))
    s = D.run_detectors(rows, ["ddos", "uneven", "lacking", "short"], (own, lacking, short), keep=("seq",))
    got = {(r.seq, r.detector): r for r in s.collect()}
    assert len(got) == 12 and [r.detector_order for r in s.where("seq = 1").collect()] == [0, 1, 2, 3]
    assert got[1, "ddos"].confidence == 0.5 and got[1, "ddos"].status == "ok"
    one, two, three = (got[i, "uneven"] for i in (1, 2, 3))
    assert (one.status, one.threat_class, one.score, one.confidence, one.severity, one.reasons) == ("ok", "UNEVEN", 0.1, 0.05, "LOW", [])
    # the row that raises has its error; the others of its batch keep their signals
    assert two.status == "error: ValueError: negative rate" and two.confidence is None and two.severity is None
    assert three.confidence == 0.45 and three.severity == "MEDIUM"
    assert got[1, "lacking"].status == "no input" and got[1, "short"].status.startswith("error: ValueError: short gave 0 rows")
    assert {r.seq for r in D.active_signals(s).collect()} == {1, 3}
    assert str(s._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    with pytest.raises(ValueError):
        D.run_detectors(rows, extra=(own, own))
