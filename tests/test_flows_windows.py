from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netsift.operators import features as X
from netsift.operators import flows as L
from netsift.operators import windows as W
from netsift.schemas import SCHEMAS

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def packets(spark, times, **kw):
    row = {"src_ip": "10.0.0.1", "src_port": 1, "dst_ip": "10.0.0.2", "dst_port": 80, "protocol": 6, "packet_length": 100} | {f"tcp_{f}": 0 for f in L.FLAGS} | kw
    rows = [row | {"seq": i, "ts": T0 + timedelta(seconds=t)} | ({"packet_length": n} if n else {}) for i, (t, n) in enumerate((x if isinstance(x, tuple) else (x, None)) for x in times)]
    return spark.createDataFrame(rows, SCHEMAS["packets"])


def test_sessions_split_over_the_gap_only(spark):
    f = L.build_flows(packets(spark, [0, 30, 61])).orderBy("start_ts").collect()
    assert [r.packet_count for r in f] == [2, 1]
    rates = L.flow_rates(L.build_flows(packets(spark, [0, 10]))).first()
    assert rates.packet_rate == pytest.approx(0.2) and rates.duration_sec == 10
    assert L.flow_rates(L.build_flows(packets(spark, [0]))).first().packet_rate == 0


def test_sequences_keep_first_lengths_and_last_gaps(spark):
    r = L.flow_sequences(packets(spark, [(0, 1), (1, 2), (3, 3), (6, 4)]), k=2).first()
    assert r.packet_lengths == [1, 2] and r.inter_arrival_times_ms == [2000.0, 3000.0]


def test_burst_window_is_inclusive(spark):
    r = W.burst_window(packets(spark, [(100, 100), (101, 200), (106, 300)]), 5).orderBy("seq").collect()[-1]
    assert (r.burst_packets, r.burst_bytes) == (2, 500)


def test_timing_window(spark):
    r = W.timing_window(packets(spark, [100, 110, 131]), 30).orderBy("seq").collect()[-1]
    base = int(T0.timestamp() * 1e6)
    assert (r.timing_count, r.first_us - base, r.last_us - base, r.iats_ms) == (2, 110_000_000, 131_000_000, [21000.0])


def test_baseline_window(spark):
    r = W.baseline_window(packets(spark, [(0, 100), (299, 200), (301, 300)]), 300, 1).orderBy("bucket").collect()[-1]
    assert (r.baseline_packets, r.baseline_bytes, r.buckets) == (2, 500, 2)


def test_late_packet_counts_at_the_newest_time(spark):
    s = W.window_snapshots(packets(spark, [100, 110, 102]), 1, 5, 30, 300).orderBy("seq").collect()
    assert s[-1].burst_packets == 2 and s[-1].timing_packets == 3


def test_temporal(spark):
    r = X.temporal_features(packets(spark, [0, 60, 120, 180]), ["src_ip"]).first()
    assert (r.inter_arrival_mean_ms, r.inter_arrival_std_ms, r.jitter_pct, r.periodicity_score) == (60000, 0, 0, 1)
    one = X.temporal_features(packets(spark, [0]), ["src_ip"]).first()
    assert one.inter_arrival_mean_ms is None and one.periodicity_score is None
    same = X.temporal_features(packets(spark, [5, 5]), ["src_ip"]).first()
    assert (same.inter_arrival_mean_ms, same.periodicity_score) == (0, 1)


def test_zscore(spark):
    rows = [("h", T0 + timedelta(seconds=i), i, float(v)) for i, v in enumerate([98, 102, 100, 99, 101, 100, 102, 5000])]
    z = W.pps_zscore(spark.createDataFrame(rows, "entity string, ts timestamp, seq long, pps double")).orderBy("seq").collect()
    assert z[6].zscore < 2 and z[7].zscore > 2
    flat = W.pps_zscore(spark.createDataFrame([("h", T0, 0, 50.0)], "entity string, ts timestamp, seq long, pps double")).first()
    assert flat.zscore == 0


def test_recon_types(spark):
    def flows(pairs):
        return spark.createDataFrame([("a", ip, port, 100, 0, 6, 0, 1) for ip, port in pairs], "src_ip string, dst_ip string, dst_port int, byte_count long, rst_count long, protocol int, syn_count long, ack_count long")

    assert X.recon_features(flows([(str(i), 80) for i in range(10)])).first().scan_type == "HORIZONTAL"
    assert X.recon_features(flows([("x", i) for i in range(6)])).first().scan_type == "VERTICAL"


def test_failed_ratio(spark):
    rows = [("a", "b", 1, n, 0, 6, 0, 1) for n in (0, 0, 500, 200)]
    r = X.recon_features(spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, byte_count long, rst_count long, protocol int, syn_count long, ack_count long")).first()
    assert (r.failed_count, r.failed_ratio) == (2, 0.5)


def test_dns(spark):
    r = X.dns_features(spark.createDataFrame([("k", "abcdefg.com", "NXDOMAIN", "A"), ("k", "abcdef.com", "NOERROR", "TXT"), ("k", "", "NOERROR", "A")], "key string, query string, rcode string, qtype string"), ["key"]).first()
    assert (r.query_length_mean, r.nxdomain_count, r.subdomain_count) == (10.5, 1, 0) and r.txt_record_ratio == pytest.approx(1 / 3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=12))
def test_throttle_keeps_its_distance(spark, times):
    kept = {r.seq for r in W.throttle(packets(spark, sorted(times)), ["src_ip"], 5.0).select("seq").collect()}
    last, expect = None, set()
    for i, t in enumerate(sorted(times)):
        if last is None or t - last >= 5:
            last = t
            expect.add(i)
    assert kept == expect


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=12))
def test_burst_equals_a_plain_count(spark, times):
    got = {r.seq: r.burst_packets for r in W.burst_window(packets(spark, times), 5).collect()}
    assert got == {i: sum(t - 5 <= u <= t for u in times) for i, t in enumerate(times)}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from(["a", "b", "c", None])), min_size=1, max_size=40))
def test_distinct_in_frame_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, v, n) for n, (k, t, v) in enumerate(rows)], "k int, t long, v string, n int")
    got = {r.n: (r.values, r.evens) for r in W.distinct_in_frame(df, ["k"], {"values": F.col("v"), "evens": F.when(F.col("t") % 2 == 0, F.col("v"))}, "t", 7).collect()}
    frame = lambda k, t, step: {v for k2, t2, v in rows if k2 == k and t - 7 <= t2 <= t and v and t2 % step == 0}
    assert got == {n: (len(frame(k, t, 1)), len(frame(k, t, 2))) for n, (k, t, v) in enumerate(rows)}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40))
def test_aggregates_in_frame_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, v) for k, t, v in rows], "k int, t long, v long")
    parts = {"n": (F.sum, F.lit(1)), "total": (F.sum, F.col("v")), "most": (F.max, F.col("v")), "first": (F.min, F.col("t"))}
    got = {(r.k, r.t): (r.n, r.total, r.most, r["first"]) for r in W.aggregated_in_frame(df, ["k"], parts, "t", 7).collect()}
    want = {}
    for k, t, _ in rows:
        own = [(t2, v) for k2, t2, v in rows if k2 == k and t - 7 <= t2 <= t]
        values = [v for _, v in own if v is not None]
        want[k, t] = (len(own), sum(values) if values else None, max(values, default=None), min(t2 for t2, _ in own))
    assert got == want


def test_rolling_features_add_up_no_frame_anew(spark):
    # a window that slides row by row adds up the whole frame for each row: many flows of one entity in one frame would not end
    flows = spark.range(40_000).selectExpr("'a' AS entity", "id % 2 = 0 AS outbound", "concat('d', id % 7) AS dst_ip", "cast(id % 5 as int) AS dst_port", "id AS byte_count", "0L AS rst_count", "timestamp_seconds(id) AS start_ts", "6 AS protocol", "0L AS syn_count", "1L AS ack_count")
    rolled = W.rolling_entity_features(flows, 30_000)
    assert "-30000000000" not in rolled._jdf.queryExecution().optimizedPlan().toString()
    last = rolled.orderBy(F.desc("start_ts")).first()
    assert (last.flows_out, last.flows_in, last.max_bytes, last.distinct_dst_ips, last.distinct_dst_ports, last.inter_arrival_mean_ms, last.inter_arrival_std_ms) == (15_000, 15_001, 39_998, 7, 5, 1000.0, 0.0)


def test_sketches_count_within_their_error(spark):
    # 30,000 addresses in 60 buckets, each row a sketch and no list of addresses
    df = spark.range(60_000).selectExpr("'a' AS src_ip", "concat('d', id % 30000) AS dst_ip", "timestamp_seconds(id div 1000) AS ts", "1L AS packet_length")
    got = W.baseline_sketches(df, 300, 1, cap=1000).orderBy("bucket").collect()
    want = [min(30_000, 1000 * (k + 1)) for k in range(60)]
    assert [r.bucket for r in got] == list(range(60)) and all(abs(r.estimate - w) <= 0.05 * w for r, w in zip(got, want)) and [r.capped for r in got][2:] == [True] * 58
    assert "collect" not in str(W.baseline_sketches(df)._jdf.queryExecution().executedPlan())


def test_ground_truth_makes_no_pairs(spark):
    from netsift.operators.evaluate import align_ground_truth

    # 3,000 decisions within 3,000 events of their peer: nine million pairs, were they made
    events = spark.range(3000).selectExpr("'p' AS entity", "concat('c', id) AS threat_class", "timestamp_seconds(86400 + 10 * (3000 - id)) AS start_ts", "timestamp_seconds(200000) AS end_ts", "id AS event_order")
    asked = spark.range(3000).selectExpr("id AS decision_id", "timestamp_seconds(86400 + 10 * id) AS ts", "concat('e', id % 7) AS entity", "'p' AS peer")
    found = align_ground_truth(asked, events)
    assert "Join" not in found._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1]
    assert {r.decision_id: r.truth for r in found.collect()} == {i: f"c{3000 - i}" if i else "BENIGN" for i in range(3000)}
