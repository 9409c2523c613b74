"""Queries over the driver's tables, one or more for each operator, with the same in SQL.

Events of one user are about seven hours apart, so durations are scaled: burst
6 h, timing 1 d, baseline 7 d in buckets of 1 h, flow gap 12 h, correlation 1 d.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir
from ..functions import scalars as S
from ..operators import correlate as C
from ..operators import detectors as D
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import flows as L
from ..operators import graph as G
from ..operators import ml as M
from ..operators import runs as R
from ..operators import windows as W
from ..schemas import SCHEMAS
from ..sources import capture_source as K
from ..sources import captures as P
from ..sources import tables as T
from . import views as V

H, DAY = 3600.0, 86400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            with_views = ", " + body[5:] if body.startswith("WITH ") else " " + body
            ORACLE_SQL[name] = f"WITH RECURSIVE {V.SQL}{with_views}" if views else body
        return f

    return add


def us(c: str, alias: str | None = None):
    return F.unix_micros(c).alias(alias or c.replace("_ts", "_us").replace("ts", "us"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places, as the last bits depend on the order of a sum."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns or [n for n, t in df.dtypes if t == "double"]})


KEY = ["src_ip", "dst_ip", "dst_port", "protocol"]
SESSIONS = """
WITH s AS (
  SELECT *, sum(CASE WHEN us - prev > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, lag(us) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY us, seq) AS prev FROM packets)
),
f AS (
  SELECT src_ip, dst_ip, dst_port, protocol, session, count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS byte_count, CAST(sum(tcp_syn) AS BIGINT) AS syn_count, CAST(sum(tcp_ack) AS BIGINT) AS ack_count,
         CAST(sum(tcp_rst) AS BIGINT) AS rst_count, min(us) AS start_us, max(us) AS end_us, (max(us) - min(us)) / 1e6 AS duration_sec
  FROM s GROUP BY ALL
)
"""


def built(spark, d):
    return L.build_flows(V.packets(spark, d), "12 hours")


@query("flow_build", SESSIONS + "SELECT src_ip, dst_ip, dst_port, protocol, start_us, end_us, packet_count, byte_count, syn_count, ack_count, rst_count FROM f")
def flow_build(spark, d):
    return built(spark, d).select(*KEY, us("start_ts"), us("end_ts"), "packet_count", "byte_count", "syn_count", "ack_count", "rst_count")


RATES = "round(coalesce(packet_count / nullif(duration_sec, 0), 0), 6) AS packet_rate, round(coalesce(byte_count / nullif(duration_sec, 0), 0), 6) AS byte_rate, round(syn_count / packet_count, 6) AS syn_ratio, round(ack_count / packet_count, 6) AS ack_ratio, round(rst_count / packet_count, 6) AS rst_ratio"


@query("flow_rates", SESSIONS + f"SELECT src_ip, dst_ip, dst_port, start_us, round(duration_sec, 6) AS duration_sec, {RATES} FROM f")
def flow_rates(spark, d):
    return rounded(L.flow_rates(built(spark, d)).select("src_ip", "dst_ip", "dst_port", us("start_ts"), "duration_sec", "packet_rate", "byte_rate", "syn_ratio", "ack_ratio", "rst_ratio"))


@query("flow_event_features", SESSIONS + "SELECT src_ip, dst_ip, dst_port, start_us, round(packet_count / CASE WHEN duration_sec > 0 THEN duration_sec ELSE 1 END, 6) AS packets_per_sec, round(byte_count / CASE WHEN duration_sec > 0 THEN duration_sec ELSE 1 END, 6) AS bytes_per_sec, CASE WHEN protocol = 6 THEN round(syn_count / packet_count, 6) END AS syn_ratio FROM f")
def flow_event_features(spark, d):
    return rounded(L.flow_event_features(built(spark, d)).select("src_ip", "dst_ip", "dst_port", us("start_ts"), "packets_per_sec", "bytes_per_sec", "syn_ratio"))


@query("flow_sequences", SESSIONS + """, n AS (
  SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol, session) AS total, greatest((us - lag(us) OVER w) / 1000, 0) AS iat
  FROM s WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, protocol, session ORDER BY us, seq)
)
SELECT src_ip, dst_ip, dst_port, CAST(session AS BIGINT) AS session, array_to_string(list(packet_length ORDER BY no) FILTER (no <= 3), ',') AS lengths,
       round(coalesce(sum(iat) FILTER (no > total - 3), 0), 6) AS iat_sum, count(iat) FILTER (no > total - 3) AS iat_count,
       round(coalesce(avg(packet_length) FILTER (no <= 3), 0), 6) AS length_mean, round(coalesce(stddev_pop(packet_length) FILTER (no <= 3), 0), 6) AS length_std
FROM n GROUP BY ALL""")
def flow_sequences(spark, d):
    df = L.flow_sequences(V.packets(spark, d), 3, 12 * H)
    stats = {c: L.sequence_stats("packet_lengths", "length")[i] for c, i in (("length_mean", 2), ("length_std", 3))}
    total = F.aggregate("inter_arrival_times_ms", F.lit(0.0), lambda s, x: s + x)
    return rounded(df.withColumns(stats).select("src_ip", "dst_ip", "dst_port", F.col("session").cast("long").alias("session"), F.array_join(F.transform("packet_lengths", lambda x: x.cast("string")), ",").alias("lengths"), total.alias("iat_sum"), F.size("inter_arrival_times_ms").cast("long").alias("iat_count"), "length_mean", "length_std"))


@query("syn_flood_alerts", SESSIONS + """, r AS (SELECT *, packet_count / nullif(duration_sec, 0) AS rate, syn_count / packet_count AS syn, ack_count / packet_count AS ack FROM f)
SELECT src_ip, dst_ip, start_us, packet_count, round((least(packet_count / 2, 1) + least(duration_sec, 1) + least(rate / 0.00001, 1) + least(syn / 0.8, 1) + (1 - least(ack / 0.1, 1))) / 5, 4) AS confidence, 'HIGH' AS severity
FROM r WHERE packet_count >= 2 AND duration_sec >= 1 AND rate >= 0.00001 AND syn >= 0.8 AND ack <= 0.1""")
def syn_flood_alerts(spark, d):
    return D.detect_syn_flood(L.flow_rates(built(spark, d)), 2, 1.0, 1e-5).select("src_ip", "dst_ip", us("start_ts"), "packet_count", "confidence", "severity")


@query("first_flow_crossing", SESSIONS + """, n AS (
  SELECT *, row_number() OVER w AS no, sum(packet_length) OVER w AS bytes, min(us) OVER w AS start_us FROM s WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, protocol, session ORDER BY us, seq ROWS UNBOUNDED PRECEDING)
) SELECT src_ip, dst_ip, dst_port, start_us, us AS end_us, CAST(no AS INTEGER) AS packet_count, CAST(bytes AS BIGINT) AS byte_count FROM n WHERE no = 2""")
def first_flow_crossing(spark, d):
    return L.first_flow_crossing(V.packets(spark, d), 2, 12 * H).select("src_ip", "dst_ip", "dst_port", us("start_ts"), us("end_ts"), "packet_count", "byte_count")


@query("attach_flow_state", SESSIONS + ", t AS (SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS flow_packets FROM packets GROUP BY ALL) SELECT seq, flow_packets FROM packets JOIN t USING (src_ip, dst_ip, dst_port, protocol) WHERE flow_packets > 1")
def attach_flow_state(spark, d):
    p = V.packets(spark, d)
    state = p.groupBy(*L.FIVE).agg(F.count(F.lit(1)).alias("flow_packets")).where("flow_packets > 1")
    return L.attach_flow_state(p, state).select("seq", "flow_packets")


@query("flow_ids", "SELECT seq, src_ip || ':40000-' || dst_ip || ':' || dst_port || '-' || protocol AS flow_id, CASE protocol WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol_name FROM packets")
def flow_ids(spark, d):
    return L.with_flow_id(V.packets(spark, d)).select("seq", "flow_id", S.protocol_name("protocol").alias("protocol_name"))


@query("inter_arrival", "WITH g AS (SELECT seq, us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, seq) AS g FROM packets) SELECT seq, CASE WHEN g IS NOT NULL THEN round(greatest(g / 1000, 0), 6) END AS iat_ms FROM g")
def inter_arrival(spark, d):
    return rounded(W.inter_arrival_ms(V.packets(spark, d), ["src_ip"]).select("seq", "iat_ms"))


GAPS = "WITH g AS (SELECT src_ip, (us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, seq)) / 1000 AS gap FROM packets), a AS (SELECT src_ip, count(*) AS n, count(gap) AS iats, avg(gap) AS m, coalesce(stddev_samp(gap), 0) AS sd, stddev_pop(gap) AS sp FROM g GROUP BY ALL)"


@query("temporal_features", GAPS + "SELECT src_ip, n AS observations, round(m, 3) AS inter_arrival_mean_ms, round(sd, 3) AS inter_arrival_std_ms, round(CASE WHEN m = 0 THEN 0 ELSE sd / m * 100 END, 6) AS jitter_pct, round(CASE WHEN m = 0 THEN 1 ELSE greatest(0, 1 - sd / m) END, 6) AS periodicity_score FROM a")
def temporal_features(spark, d):
    df = X.temporal_features(V.packets(spark, d), ["src_ip"])
    return df.select("src_ip", "observations", *(F.round(c, 3).alias(c) for c in ("inter_arrival_mean_ms", "inter_arrival_std_ms")), *(F.round(c, 6).alias(c) for c in ("jitter_pct", "periodicity_score")))


@query("packet_periodicity", GAPS + "SELECT src_ip, iats, round(sp / m * 100, 6) AS jitter_pct, round(greatest(0, least(1, 1 - sp / m * 100 / 50)), 6) AS periodicity_score FROM a WHERE iats >= 3")
def packet_periodicity(spark, d):
    return rounded(X.packet_periodicity(V.packets(spark, d), ["src_ip"]).select("src_ip", "iats", "jitter_pct", "periodicity_score"))


@query("temporal_of_last_flow", GAPS + ", z AS (SELECT src_ip, arg_max(dst_ip, (us, seq)) AS dst_ip FROM packets GROUP BY ALL) SELECT src_ip, n AS observations, dst_ip, round(m, 3) AS inter_arrival_mean_ms, round(CASE WHEN m = 0 THEN 0 ELSE sd / m * 100 END, 6) AS jitter_pct FROM a JOIN z USING (src_ip)")
def temporal_of_last_flow(spark, d):
    return X.temporal_features_of_last_flow(V.packets(spark, d), ["src_ip"], ["dst_ip"]).select("src_ip", "observations", "dst_ip", F.round("inter_arrival_mean_ms", 3).alias("inter_arrival_mean_ms"), F.round("jitter_pct", 6).alias("jitter_pct"))


RANGE = "(PARTITION BY src_ip ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("burst_window", f"SELECT seq, count(*) OVER w AS burst_packets, CAST(sum(packet_length) OVER w AS BIGINT) AS burst_bytes, CAST(sum(tcp_syn) OVER w AS BIGINT) AS burst_syn, CAST(sum(tcp_ack) OVER w AS BIGINT) AS burst_ack, round(count(*) OVER w / 21600, 9) AS burst_rate FROM packets WINDOW w AS {RANGE.format(21600000000)}")
def burst_window(spark, d):
    return W.burst_window(V.packets(spark, d), 6 * H).select("seq", "burst_packets", "burst_bytes", "burst_syn", "burst_ack", F.round("burst_rate", 9).alias("burst_rate"))


@query("timing_window", f"WITH t AS (SELECT seq, list_sort(list(us) OVER w) AS t FROM packets WINDOW w AS {RANGE.format(86400000000)}) SELECT seq, CAST(len(t) AS BIGINT) AS timing_count, t[1] AS first_us, t[-1] AS last_us, array_to_string(list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]), ',') AS gaps FROM t")
def timing_window(spark, d):
    gaps = F.array_join(F.transform("iats_ms", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return W.timing_window(V.packets(spark, d), DAY).select("seq", "timing_count", "first_us", "last_us", gaps.alias("gaps"))


@query("timing_stats", """
WITH w AS (SELECT seq, count(*) OVER w AS timing_count, min(us) OVER w AS first_us, us AS last_us, list_sort(list(us) OVER w) AS t FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_transform(range(2, len(t) + 1), lambda i: (t[i] - t[i - 1]) / 1e6) AS gaps FROM w)
SELECT seq, timing_count, first_us, last_us, round(list_avg(gaps)) AS mean_sec, round(CASE WHEN len(gaps) = 1 THEN 0 ELSE list_stddev_samp(gaps) END) AS std_sec FROM g""")
def timing_stats(spark, d):
    t = W.timing_stats(V.packets(spark, d), DAY)
    return t.select("seq", "timing_count", "first_us", "last_us", F.round(F.col("mean_iat_ms") / 1000).alias("mean_sec"), F.round(F.col("std_iat_ms") / 1000).alias("std_sec"))


@query("baseline_window", """
WITH b AS (SELECT src_ip, us // 3600000000 AS bucket, count(*) AS n, sum(packet_length) AS bytes, list(DISTINCT dst_ip) AS dsts FROM packets GROUP BY ALL)
SELECT src_ip, bucket, CAST(sum(n) OVER w AS BIGINT) AS baseline_packets, CAST(sum(bytes) OVER w AS BIGINT) AS baseline_bytes, count(*) OVER w AS buckets, CAST(len(list_distinct(flatten(list(dsts) OVER w))) AS BIGINT) AS distinct_dst, 1::BIGINT AS distinct_src, array_to_string(list(n) OVER w, ',') AS bucket_packets, array_to_string(list(CAST(bytes AS BIGINT)) OVER w, ',') AS bucket_bytes
FROM b WINDOW w AS (PARTITION BY src_ip ORDER BY bucket RANGE BETWEEN 168 PRECEDING AND CURRENT ROW)""")
def baseline_window(spark, d):
    b = W.baseline_window(V.packets(spark, d), 7 * DAY, H)
    return b.withColumns({c: F.array_join(c, ",") for c in ("bucket_packets", "bucket_bytes")})


@query("baseline_sketches", """
WITH b AS (SELECT src_ip, us // 3600000000 AS bucket, list(DISTINCT dst_port) AS ports FROM packets GROUP BY ALL)
SELECT src_ip, bucket, CAST(len(list_distinct(flatten(list(ports) OVER w))) AS BIGINT) AS estimate, len(list_distinct(flatten(list(ports) OVER w))) > 3 AS capped
FROM b WINDOW w AS (PARTITION BY src_ip ORDER BY bucket RANGE BETWEEN 168 PRECEDING AND CURRENT ROW)""")
def baseline_sketches(spark, d):
    # sketches of so few ports count exactly
    return W.baseline_sketches(V.packets(spark, d), 7 * DAY, H, value="dst_port", cap=3)


@query("burst_sources", """
SELECT p.seq, count(*) FILTER (q.src_ip = p.src_ip) AS source_packets, count(DISTINCT q.src_ip) AS sources
FROM packets p JOIN packets q ON q.dst_ip = p.dst_ip AND q.dst_port = p.dst_port AND q.us BETWEEN p.us - 3600000000 AND p.us GROUP BY p.seq""")
def burst_sources(spark, d):
    return W.burst_sources(V.packets(spark, d), H, ["dst_ip", "dst_port"]).select("seq", "source_packets", "sources")


@query("window_snapshots", f"""
WITH n AS (SELECT seq, row_number() OVER (PARTITION BY src_ip ORDER BY us, seq) AS packet_no, count(*) OVER b AS burst_packets, count(*) OVER t AS timing_packets, count(*) OVER l AS baseline_packets, CAST(sum(packet_length) OVER l AS BIGINT) AS baseline_bytes, CAST(sum(tcp_syn) OVER b AS BIGINT) AS burst_syn, CAST(sum(tcp_ack) OVER b AS BIGINT) AS burst_ack, round(sum(packet_length) OVER b / 21600, 9) AS burst_byte_rate, min(us) OVER t AS timing_first_us, us AS timing_last_us
FROM packets WINDOW b AS {RANGE.format(21600000000)}, t AS {RANGE.format(86400000000)}, l AS {RANGE.format(604800000000)})
SELECT seq, burst_packets, timing_packets, baseline_packets, baseline_bytes, burst_syn, burst_ack, burst_byte_rate, timing_first_us, timing_last_us FROM n WHERE packet_no % 5 = 0""")
def window_snapshots(spark, d):
    return W.window_snapshots(V.packets(spark, d), 5, 6 * H, DAY, 7 * DAY).select("seq", "burst_packets", "timing_packets", "baseline_packets", "baseline_bytes", "burst_syn", "burst_ack", F.round("burst_byte_rate", 9).alias("burst_byte_rate"), "timing_first_us", "timing_last_us")


ENDS = """
WITH e AS (SELECT seq, us, src_ip AS entity, true AS outbound, dst_ip, dst_port, byte_count, rst_count FROM flows UNION ALL SELECT seq, us, dst_ip, false, dst_ip, dst_port, byte_count, rst_count FROM flows)
"""


@query("explode_entities", ENDS + "SELECT entity, outbound, count(*) AS n, CAST(sum(byte_count) AS BIGINT) AS bytes FROM e GROUP BY ALL")
def explode_entities(spark, d):
    return L.explode_entities(V.flows(spark, d)).groupBy("entity", "outbound").agg(F.count(F.lit(1)).alias("n"), F.sum("byte_count").alias("bytes"))


@query("distinct_entities", "SELECT src_ip AS entity FROM flows UNION SELECT dst_ip FROM flows")
def distinct_entities(spark, d):
    return L.distinct_entities(V.flows(spark, d))


@query("flow_direction", ENDS + "SELECT entity, CASE WHEN outbound THEN 'OUT' ELSE 'IN' END AS direction, count(*) AS n FROM e GROUP BY ALL")
def flow_direction(spark, d):
    e = L.explode_entities(V.flows(spark, d))
    return e.groupBy("entity", L.flow_direction("entity").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("rolling_entity_features", ENDS + """
, g AS (SELECT *, coalesce(power((us - lag(us) OVER (PARTITION BY entity ORDER BY us)) / 1000, 2), 0) AS gap2 FROM e), fg AS (SELECT entity, us, max(gap2) AS first2 FROM g GROUP BY ALL),
r AS (SELECT seq, us, entity, CAST(sum(CAST(outbound AS INTEGER)) OVER w AS BIGINT) AS flows_out, CAST(sum(CASE WHEN outbound THEN byte_count ELSE 0 END) OVER w AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN outbound THEN 0 ELSE byte_count END) OVER w AS BIGINT) AS bytes_in,
       CAST(len(list_distinct(list(CASE WHEN outbound THEN dst_ip END) OVER w)) AS BIGINT) AS distinct_dst_ips, CAST(len(list_distinct(list(CASE WHEN outbound THEN dst_port END) OVER w)) AS BIGINT) AS distinct_dst_ports,
       coalesce(max(CASE WHEN outbound THEN byte_count END) OVER w, 0) AS max_bytes, count(*) FILTER (NOT outbound) OVER w AS flows_in,
       count(*) FILTER (outbound AND (byte_count = 0 OR (rst_count > 0 AND byte_count < 64))) OVER w AS failed, count(*) FILTER (outbound AND byte_count >= 1000000) OVER w AS large_transfers,
       count(*) OVER w - 1 AS n, min(us) OVER w AS lo, sum(gap2) OVER w AS squares
FROM g WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)),
m AS (SELECT r.*, first2, CASE WHEN n > 0 THEN (r.us - lo) / 1000 / n END AS mean FROM r JOIN fg ON fg.entity = r.entity AND fg.us = lo)
SELECT seq, entity, flows_out, bytes_out, bytes_in, distinct_dst_ips, distinct_dst_ports, max_bytes, flows_in, failed, large_transfers, round(mean / 1000) AS inter_arrival_mean_sec,
       round(CASE WHEN n > 1 THEN sqrt(greatest(0, (squares - first2 - n * mean * mean) / (n - 1))) WHEN n = 1 THEN 0 END / 1000) AS inter_arrival_std_sec FROM m""")
def rolling_entity_features(spark, d):
    return W.rolling_entity_features(L.explode_entities(V.flows(spark, d)), 7 * DAY).select("seq", "entity", "flows_out", "bytes_out", "bytes_in", "distinct_dst_ips", "distinct_dst_ports", "max_bytes", "flows_in", "failed", "large_transfers", F.round(F.col("inter_arrival_mean_ms") / 1000).alias("inter_arrival_mean_sec"), F.round(F.col("inter_arrival_std_ms") / 1000).alias("inter_arrival_std_sec"))


@query("pps_zscore", """
WITH w AS (SELECT seq, pps, avg(pps) OVER h AS m, coalesce(stddev_samp(pps) OVER h, 0) AS sd FROM ctx WINDOW h AS (PARTITION BY entity ORDER BY us, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT seq, round(CASE WHEN sd >= 0.00001 THEN greatest(0, (pps - m) / sd) WHEN m > 0 THEN greatest(0, (pps - m) / greatest(m, 1)) WHEN pps <= 10 THEN 0 ELSE pps / 10 END, 6) AS zscore FROM w""")
def pps_zscore(spark, d):
    return rounded(W.pps_zscore(V.contexts(spark, d)).select("seq", "zscore"))


@query("first_seen_destination", "SELECT seq, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY us, seq) = 1 AS is_new_destination FROM flows")
def first_seen_destination(spark, d):
    return W.first_seen_destination(V.flows(spark, d)).select("seq", "is_new_destination")


@query("throttle", """
WITH n AS (SELECT seq, us, src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY us, seq) AS no FROM packets),
k AS (
  SELECT src_ip, no, seq, us AS last, true AS kept FROM n WHERE no = 1
  UNION ALL
  SELECT n.src_ip, n.no, n.seq, CASE WHEN n.us - k.last >= 43200000000 THEN n.us ELSE k.last END, n.us - k.last >= 43200000000 FROM k JOIN n ON n.src_ip = k.src_ip AND n.no = k.no + 1
) SELECT seq FROM k WHERE kept""")
def throttle(spark, d):
    return W.throttle(V.packets(spark, d), ["src_ip"], 12 * H).select("seq")


RECON = "WITH r AS (SELECT src_ip, count(*) AS flow_count, count(DISTINCT dst_ip) AS ips, count(DISTINCT dst_port) AS ports, count(*) FILTER (byte_count = 0 OR (rst_count > 0 AND byte_count < 64)) AS failed FROM flows GROUP BY ALL)"


@query("recon_features", RECON + "SELECT src_ip, flow_count, ips AS unique_dst_ips, ports AS unique_dst_ports, failed AS failed_count, round(failed / flow_count, 6) AS failed_ratio, round(flow_count / 2592000, 9) AS connection_rate, CASE WHEN ips >= 5 AND ports >= 5 THEN 'BROAD' WHEN ips >= 5 THEN 'HORIZONTAL' WHEN ports >= 5 THEN 'VERTICAL' ELSE 'NONE' END AS scan_type, flow_count >= 3 AS sufficient FROM r")
def recon_features(spark, d):
    df = X.recon_features(V.flows(spark, d), ["src_ip"], 30 * DAY)
    return df.withColumns({"failed_ratio": F.round("failed_ratio", 6), "connection_rate": F.round("connection_rate", 9)})


EXFIL = ENDS + """, x AS (
  SELECT entity, count(*) AS flow_count, count(*) FILTER (outbound) AS outbound_flows, count(*) FILTER (NOT outbound) AS inbound_flows, CAST(coalesce(sum(byte_count) FILTER (outbound), 0) AS BIGINT) AS outbound_bytes, CAST(coalesce(sum(byte_count) FILTER (NOT outbound), 0) AS BIGINT) AS inbound_bytes,
         max(byte_count) AS max_flow_bytes, count(*) FILTER (byte_count >= 1000000) AS large_transfers, count(DISTINCT dst_ip) FILTER (outbound) AS destinations, CASE WHEN max(us) > min(us) THEN (max(us) - min(us)) / 1e6 ELSE 60 END AS window_sec
  FROM e GROUP BY ALL)
"""


@query("exfil_features", EXFIL + "SELECT entity, flow_count, outbound_flows, inbound_flows, outbound_bytes, inbound_bytes, max_flow_bytes, large_transfers, destinations, round(outbound_bytes / nullif(outbound_bytes + inbound_bytes, 0), 6) AS outbound_share, round(CASE WHEN inbound_bytes > 0 THEN outbound_bytes / inbound_bytes END, 6) AS up_down_ratio, round(outbound_bytes / window_sec, 4) AS outbound_rate FROM x")
def exfil_features(spark, d):
    df = X.exfil_features(V.flows(spark, d)).withColumns({"outbound_share": F.round("outbound_share", 6), "up_down_ratio": F.round("up_down_ratio", 6), "outbound_rate": F.round("outbound_rate", 4)})
    return df.drop("window_sec", "sufficient", "direction_available")


@query("in_out_volumes", EXFIL + "SELECT entity, outbound_bytes AS out_bytes, inbound_bytes AS in_bytes FROM x")
def in_out_volumes(spark, d):
    return X.in_out_volumes(V.flows(spark, d))


@query("capped_cardinality", "SELECT src_ip, least(count(DISTINCT dst_ip), 20) AS cardinality, count(DISTINCT dst_ip) > 20 AS capped FROM flows GROUP BY ALL")
def capped_cardinality(spark, d):
    return X.capped_cardinality(V.flows(spark, d), ["src_ip"], "dst_ip", 20)


@query("entity_profiles", "SELECT src_ip AS entity, min(us) AS first_seen, max(us) AS last_seen, count(*) AS observations, count(DISTINCT dst_ip) AS known_destinations, count(DISTINCT dst_port) AS known_ports FROM flows GROUP BY ALL")
def entity_profiles(spark, d):
    p = X.entity_profiles(V.flows(spark, d).withColumnRenamed("src_ip", "entity"))
    return p.withColumns({"first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


@query("most_recent_entities", "WITH p AS (SELECT src_ip AS entity, max(us) AS last_seen FROM flows GROUP BY ALL) SELECT entity, last_seen FROM p WHERE last_seen >= (SELECT max(last_seen) FROM p) - 86400000000 ORDER BY last_seen DESC, entity LIMIT 20")
def most_recent_entities(spark, d):
    p = X.entity_profiles(V.flows(spark, d).withColumnRenamed("src_ip", "entity"))
    return X.most_recent_entities(p, 20, DAY).select("entity", F.unix_micros("last_seen").alias("last_seen"))


@query("sample_known_destinations", "SELECT src_ip, array_to_string(list_slice(list_sort(list(DISTINCT dst_ip)), 1, 5), ',') AS sample FROM flows GROUP BY ALL")
def sample_known_destinations(spark, d):
    return X.sample_known_destinations(V.flows(spark, d)).withColumn("sample", F.array_join("sample", ","))


@query("new_destinations", "SELECT DISTINCT src_ip AS entity, dst_ip FROM flows WHERE us >= 1705276800000000 EXCEPT SELECT src_ip, dst_ip FROM flows WHERE us < 1705276800000000")
def new_destinations(spark, d):
    f = V.flows(spark, d).withColumnRenamed("src_ip", "entity")
    late = F.unix_micros("ts") >= 1705276800000000
    return X.new_destinations(f.where(late), f.where(~late).select("entity", "dst_ip").distinct())


@query("asof_baseline", """
WITH p AS (SELECT entity, us // 86400000000 * 86400000000 + 86399999999 AS us, avg(pps) AS base FROM ctx GROUP BY ALL)
SELECT c.seq, round(p.base, 6) AS base FROM ctx c ASOF LEFT JOIN p ON c.entity = p.entity AND c.us >= p.us""")
def asof_baseline(spark, d):
    c = V.contexts(spark, d)
    day = F.timestamp_micros(F.floor(F.unix_micros("ts") / 86400000000) * 86400000000 + 86399999999)
    p = c.groupBy("entity", day.alias("ts")).agg(F.avg("pps").alias("base"))
    return rounded(X.asof_baseline(c.select("entity", "ts", "seq"), p, "base").select("seq", "base"))


ENT = "list_sum(list_transform(list_distinct(string_split(q, '')), lambda c: -len(list_filter(string_split(q, ''), lambda x: x = c)) / length(q) * log2(len(list_filter(string_split(q, ''), lambda x: x = c)) / length(q))))"


@query("dns_entropy", f"SELECT seq, query, round({ENT.replace('q', 'query')}, 6) AS entropy FROM dns")
def dns_entropy(spark, d):
    return V.dns_records(spark, d).select("seq", "query", F.round(S.shannon_entropy("query"), 6).alias("entropy"))


SUB = "CASE WHEN len(p) <= 2 THEN false WHEN len(p) = 3 THEN NOT (p[-2] IN ('co', 'com', 'org', 'net', 'gov', 'ac', 'edu') AND length(p[-1]) = 2) ELSE true END"


@query("has_subdomain", f"SELECT seq, {SUB} AS has_subdomain FROM (SELECT seq, string_split(lower(query), '.') AS p FROM dns)")
def has_subdomain(spark, d):
    return V.dns_records(spark, d).select("seq", S.has_subdomain("query").alias("has_subdomain"))


DNSF = f"WITH q AS (SELECT *, query AS q, string_split(lower(query), '.') AS p FROM dns), df AS (SELECT key, avg(length(q)) AS query_length_mean, avg({ENT}) AS entropy_mean, count(*) FILTER (rcode = 'NXDOMAIN') AS nxdomain_count, avg(CASE WHEN qtype = 'TXT' THEN 1.0 ELSE 0.0 END) AS txt_record_ratio, count(*) FILTER ({SUB}) AS subdomain_count FROM q GROUP BY ALL)"


@query("dns_features", DNSF + "SELECT key, round(query_length_mean, 6) AS query_length_mean, round(entropy_mean, 6) AS entropy_mean, nxdomain_count, round(txt_record_ratio, 6) AS txt_record_ratio, subdomain_count FROM df")
def dns_features(spark, d):
    return rounded(X.dns_features(V.dns_records(spark, d), ["key"]))


@query("tls_features", "SELECT entity, arg_min(ja3, seq) FILTER (ja3 IS NOT NULL) AS ja3, arg_min(sni, seq) FILTER (sni IS NOT NULL) AS sni, arg_min(alpn, seq) FILTER (alpn IS NOT NULL) AS alpn FROM ctx GROUP BY ALL")
def tls_features(spark, d):
    return X.tls_features(V.contexts(spark, d), ["entity"]).drop("ja4")


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0, least(1.0, ({x} - {lo}) / ({hi} - {lo})))"


def _band(c: str) -> str:
    return f"CASE WHEN {c} >= 0.7 THEN 'HIGH' WHEN {c} >= 0.4 THEN 'MEDIUM' WHEN {c} >= 0.1 THEN 'LOW' ELSE 'INFO' END"


DDOS = f"0.5 * {_ramp('pps', 1000.0, 5000.0)} + CASE WHEN coalesce(syn_ratio, 0) > 0.8 THEN 0.5 ELSE 0 END"
C2_FULL = "least(periodicity * 0.6, 0.6) + CASE WHEN jitter < 50 THEN 0.4 * (1 - jitter / 50) ELSE 0 END"
C2_SCORE = f"CASE WHEN periodicity IS NULL OR jitter IS NULL THEN 0 WHEN observations < 5 THEN least({C2_FULL}, 0.4) ELSE {C2_FULL} END"
C2_CONF = f"CASE WHEN periodicity IS NULL OR jitter IS NULL THEN 0 WHEN observations < 5 THEN least({C2_FULL}, 0.3) ELSE least({C2_FULL}, 0.85) END"
ENC_SCORE = "CASE WHEN ja3 IS NULL AND sni IS NULL AND alpn IS NULL THEN 0 ELSE 0.3 * (CASE WHEN ja3 IS NOT NULL AND sni IS NULL THEN 0.5 ELSE 0 END + CASE WHEN sni IS NOT NULL AND alpn IS NULL THEN 0.2 ELSE 0 END) + 0.7 * coalesce(least(least(periodicity * 0.7, 0.7) + CASE WHEN jitter < 50 THEN 0.3 * (1 - jitter / 50) ELSE 0 END, 1), 0) END"
ENC_CONF = f"({ENC_SCORE}) * ((CAST(ja3 IS NOT NULL AS INTEGER) + CAST(sni IS NOT NULL AS INTEGER) + CAST(alpn IS NOT NULL AS INTEGER)) / 4.0) * 0.85"
ZSCORE = "CASE WHEN sd >= 0.00001 THEN greatest(0, (pps - m) / sd) WHEN m > 0 THEN greatest(0, (pps - m) / greatest(m, 1)) WHEN pps <= 10 THEN 0 ELSE pps / 10 END"
ZWINDOW = "(PARTITION BY entity ORDER BY us, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
SIG = f"""
WITH d AS (SELECT *, {ZSCORE} AS z, {DDOS} AS c_ddos, {C2_CONF} AS c_c2, {C2_SCORE} AS s_c2, {ENC_SCORE} AS s_enc, {ENC_CONF} AS c_enc FROM (SELECT *, avg(pps) OVER h AS m, coalesce(stddev_samp(pps) OVER h, 0) AS sd FROM ctx WINDOW h AS {ZWINDOW})),
sig AS (
  SELECT seq, us, entity, target, 0 AS o, 'VOLUMETRIC_DDOS' AS threat_class, c_ddos AS confidence, CASE WHEN c_ddos >= 0.9 THEN 'CRITICAL' ELSE {_band('c_ddos')} END AS severity, z FROM d
  UNION ALL SELECT seq, us, entity, target, 1, 'BOTNET_C2_BEACONING', c_c2, {_band('c_c2')}, z FROM d
  UNION ALL SELECT seq, us, entity, target, 2, 'ENCRYPTED_MALWARE', c_enc, {_band('c_enc')}, z FROM d
)
"""
FAR = "CASE WHEN {0} > 2 THEN least(0.15, 0.03 * ({0} - 2)) ELSE 0 END"


def _detected(spark, d, name, keep=("seq",)):
    return D.detect(V.contexts(spark, d), name).select(*keep, F.round("score", 6).alias("score"), F.round("confidence", 10).alias("confidence"), "severity", F.array_join("reasons", ",").alias("reasons"))


@query("detect_ddos", SIG + """SELECT seq, round(c_ddos, 6) AS score, round(c_ddos, 10) AS confidence, sig.severity, concat_ws(',', CASE WHEN pps > 5000 THEN 'critical_packet_velocity_exceeded' WHEN pps > 1000 THEN 'suspicious_packet_velocity_observed' END,
  CASE WHEN syn_ratio > 0.8 THEN 'critical_tcp_syn_flood_ratio' WHEN syn_ratio > 0.5 THEN 'elevated_tcp_syn_ratio' END) AS reasons FROM d JOIN sig USING (seq) WHERE o = 0""")
def detect_ddos(spark, d):
    return _detected(spark, d, "ddos")


@query("detect_c2", SIG + """SELECT seq, round(s_c2, 6) AS score, round(c_c2, 10) AS confidence, sig.severity, concat_ws(',', CASE WHEN periodicity >= 0.8 THEN 'high_temporal_periodicity_observed' END, CASE WHEN jitter <= 15 THEN 'low_inter_arrival_jitter_beacon' END,
  CASE WHEN periodicity IS NOT NULL AND observations < 5 THEN 'insufficient_observations_penalty_applied' END) AS reasons FROM d JOIN sig USING (seq) WHERE o = 1""")
def detect_c2(spark, d):
    return _detected(spark, d, "c2")


@query("detect_encrypted", SIG + """SELECT seq, round(s_enc, 6) AS score, round(c_enc, 10) AS confidence, sig.severity, concat_ws(',', CASE WHEN ja3 IS NOT NULL THEN 'suspicious_ja3_fingerprint_match' END,
  CASE WHEN periodicity IS NOT NULL AND (ja3 IS NOT NULL OR sni IS NOT NULL OR alpn IS NOT NULL) THEN 'correlated_temporal_periodicity_observed' END) AS reasons FROM d JOIN sig USING (seq) WHERE o = 2""")
def detect_encrypted(spark, d):
    return _detected(spark, d, "encrypted")


DNS_SCORE = " + ".join(f"{w} * {_ramp(c, lo, hi)}" for c, lo, hi, w in D.DNS_PARTS)


@query("detect_dns", DNSF + f", z AS (SELECT key, {DNS_SCORE} AS s FROM df) SELECT key, round(s, 6) AS score, round(s * 0.9, 6) AS confidence, {_band('s * 0.9')} AS severity FROM z")
def detect_dns(spark, d):
    df = D.detect(X.dns_features(V.dns_records(spark, d), ["key"]), "dns")
    return rounded(df.select("key", "score", "confidence", "severity"))


RECON_SCORE = f"0.35 * {_ramp('ips', 3.0, 30.0)} + 0.35 * {_ramp('ports', 5.0, 100.0)} + 0.2 * {_ramp('flow_count / 2592000', 0.5, 20.0)} + 0.1 * {_ramp('failed / flow_count', 0.3, 0.9)}"


@query("detect_recon", RECON + f", z AS (SELECT *, {RECON_SCORE} AS s FROM r), y AS (SELECT src_ip, CASE WHEN flow_count >= 3 THEN s ELSE 0 END AS score, CASE WHEN flow_count >= 3 THEN s * 0.9 ELSE 0.1 END AS c, flow_count >= 3 AS ok FROM z) SELECT src_ip, round(score, 6) AS score, round(c, 6) AS confidence, CASE WHEN ok THEN {_band('c')} ELSE 'INFO' END AS severity FROM y")
def detect_recon(spark, d):
    df = D.detect(X.recon_features(V.flows(spark, d), ["src_ip"], 30 * DAY), "recon")
    return rounded(df.select("src_ip", "score", "confidence", "severity"))


@query("detect_exfil", EXFIL + f""", p AS (SELECT *, outbound_bytes / window_sec AS rate, CASE WHEN inbound_bytes > 0 THEN outbound_bytes / inbound_bytes END AS ratio FROM x),
z AS (SELECT entity, flow_count, 0.75 + CASE WHEN ratio IS NULL THEN 0 ELSE 0.25 END AS w, (0.35 * {_ramp('outbound_bytes', 1e7, 5e8)} + 0.3 * {_ramp('rate', 1e5, 1e7)} + 0.25 * coalesce({_ramp('ratio', 2.0, 50.0)}, 0) * CAST(ratio IS NOT NULL AS INTEGER) + 0.1 * {_ramp('large_transfers', 1.0, 10.0)}) AS t FROM p),
y AS (SELECT entity, CASE WHEN flow_count >= 3 THEN t / w ELSE 0 END AS s, CASE WHEN flow_count >= 3 THEN t / w * w * 0.9 ELSE 0 END AS c FROM z)
SELECT entity, round(s, 6) AS score, round(c, 6) AS confidence, {_band('c')} AS severity FROM y""")
def detect_exfil(spark, d):
    return rounded(D.detect(X.exfil_features(V.flows(spark, d)), "exfil").select("entity", "score", "confidence", "severity"))


@query("entity_fingerprints", SIG + ", a AS (SELECT entity, least(count(*), 100) AS active_signals FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO' GROUP BY ALL), p AS (SELECT entity, min(us) AS first_seen, max(us) AS last_seen, count(*) AS observations, count(DISTINCT ja3) AS known_ja3, count(DISTINCT ja4) AS known_ja4, count(DISTINCT sni) AS known_domains FROM ctx GROUP BY ALL) SELECT p.*, coalesce(active_signals, 0) AS active_signals FROM p LEFT JOIN a USING (entity)")
def entity_fingerprints(spark, d):
    p = X.entity_profiles(V.contexts(spark, d), D.active_signals(signals(spark, d)))
    return p.withColumns({"first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


def signals(spark, d):
    """Three detectors over the contexts, with what correlation needs."""
    keep = ("entity", "ts", "seq", "target", "zscore")
    s = D.run_detectors(W.pps_zscore(V.contexts(spark, d)), ["ddos", "c2", "encrypted"], keep=keep)
    kind = F.when(F.col("threat_class") == "VOLUMETRIC_DDOS", "DETERMINISTIC_BASELINE").otherwise("LIGHTWEIGHT_ML")
    return s.withColumn("detector_type", kind).withColumn("signal_id", S.stable_id("sig-", "seq", "detector_order"))


@query("run_detectors", SIG + "SELECT seq, threat_class, round(confidence, 10) AS confidence, severity, o AS detector_order FROM sig")
def run_detectors(spark, d):
    return signals(spark, d).select("seq", "threat_class", F.round("confidence", 10).alias("confidence"), "severity", "detector_order")


@query("active_signals", SIG + "SELECT seq, threat_class, severity FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO'")
def active_signals(spark, d):
    return D.active_signals(signals(spark, d)).select("seq", "threat_class", "severity")


@query("top_signal", SIG + "SELECT seq, arg_max(threat_class, (confidence, -o)) AS predicted, round(max(confidence), 6) AS confidence FROM sig GROUP BY ALL")
def top_signal(spark, d):
    return rounded(D.top_signal(signals(spark, d), ("seq",)))


GROUPS = SIG + f""", act AS (SELECT *, CASE WHEN threat_class = 'VOLUMETRIC_DDOS' THEN 'DETERMINISTIC_BASELINE' ELSE 'LIGHTWEIGHT_ML' END AS dt FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO'),
grp AS (SELECT *, CAST(sum(CASE WHEN us - prev > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM (SELECT *, lag(us) OVER (PARTITION BY entity ORDER BY us, o) AS prev FROM act)),
rk AS (SELECT entity, group_no, count(*) AS signals, count(DISTINCT threat_class) AS classes, least(0.99, max(confidence) + least(0.25, 0.1 * (count(DISTINCT threat_class) - 1)) + CASE WHEN count(DISTINCT dt) > 1 THEN 0.1 ELSE 0 END + {FAR.format('max(z)')}) AS risk, bool_or(severity = 'CRITICAL') AS cr, bool_or(severity = 'HIGH') AS hi FROM grp GROUP BY ALL)
"""


def grouped(spark, d):
    return C.group_signals(D.active_signals(signals(spark, d)), DAY)


@query("correlate", GROUPS + "SELECT seq, o AS detector_order, group_no FROM grp")
def correlate(spark, d):
    return grouped(spark, d).select("seq", "detector_order", "group_no")


RISK_SEVERITY = "CASE WHEN risk >= 0.9 OR cr THEN 'CRITICAL' WHEN risk >= 0.7 OR hi THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query("composite_risk", GROUPS + f"SELECT entity, group_no, signals, classes, round(risk, 6) AS risk, {RISK_SEVERITY} AS severity FROM rk")
def composite_risk(spark, d):
    return rounded(C.composite_risk(grouped(spark, d)))


PROGRESS = GROUPS + f""", pr AS (SELECT seq, o, us, entity, group_no, threat_class, least(0.99, max(confidence) OVER w + least(0.25, 0.1 * (len(list_distinct(list(threat_class) OVER w)) - 1)) + CASE WHEN len(list_distinct(list(dt) OVER w)) > 1 THEN 0.1 ELSE 0 END + {FAR.format('z')}) AS running_risk FROM grp
WINDOW w AS (PARTITION BY entity, group_no ORDER BY us, o ROWS UNBOUNDED PRECEDING))
"""


@query("risk_progression", PROGRESS + "SELECT seq, o AS detector_order, round(running_risk, 6) AS running_risk FROM pr")
def risk_progression(spark, d):
    return rounded(C.risk_progression(grouped(spark, d)).select("seq", "detector_order", "running_risk"))


@query("fused_prediction", PROGRESS + "SELECT entity, group_no, CASE WHEN max(round(running_risk, 9)) >= 0.4 THEN arg_max(threat_class, (round(running_risk, 9), -us, -o)) ELSE 'BENIGN' END AS predicted, round(max(running_risk), 6) AS risk FROM pr GROUP BY ALL")
def fused_prediction(spark, d):
    p = C.risk_progression(grouped(spark, d)).withColumn("running_risk", F.round("running_risk", 9))
    return rounded(C.fused_prediction(p))


@query("active_groups", GROUPS + "SELECT entity, group_no, max(us) AS last_us FROM grp GROUP BY ALL HAVING max(us) >= 1706486400000000 - 86400000000")
def active_groups(spark, d):
    from datetime import UTC, datetime

    return C.active_groups(grouped(spark, d), datetime(2024, 1, 29, tzinfo=UTC), DAY).select("entity", "group_no", us("last_ts"))


STAGE = "CASE threat_class WHEN 'BOTNET_C2_BEACONING' THEN 'C2_ESTABLISHMENT' WHEN 'ENCRYPTED_MALWARE' THEN 'MALWARE_EXECUTION' ELSE 'IMPACT_DENIAL_OF_SERVICE' END"


@query("threat_stages", GROUPS + f"SELECT entity, us, threat_class, {STAGE} AS stage, round(confidence, 10) AS confidence FROM grp")
def threat_stages(spark, d):
    return C.threat_stages(grouped(spark, d)).select("entity", us("ts"), "threat_class", "stage", F.round("confidence", 10).alias("confidence"))


def grouped_once(spark, d):
    """The same, written once for what reads it more than once."""
    g, path = grouped(spark, d), f"{shared_dir(spark)}/grouped-{uuid.uuid4().hex}"
    g.write.parquet(path)
    return spark.read.schema(g.schema).parquet(path)


def incidents_of(g):
    told = ["threat_class", "detector_type", "confidence", "zscore"]
    return C.build_incidents(g.withColumn("evidence", C.evidence_items(told)))


def _fixed(x: str, places: int) -> str:
    """A number as texts tell it: to nine places, and of these half up, in decimals, to so many."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(38, 9)), {places}) AS DECIMAL(38, {places})) AS VARCHAR)"


#: The evidence text of a signal that has a deviation and no other features.
TEXT = f"CASE WHEN z > 2 THEN 'Traffic velocity deviates significantly (+' || {_fixed('z', 1)} || 'σ) from host baseline' ELSE 'Automated detector signal: ' || dt || ' confidence ' || {_fixed('confidence', 2)} END"
INC = GROUPS + f""", inc AS (SELECT entity, group_no, min(us) AS first_us, max(us) AS last_us, array_to_string(list({STAGE} ORDER BY us, o), ',') AS stages, list({TEXT} ORDER BY us, o) AS texts, arg_max(threat_class, (confidence, -us, -o)) AS main_class FROM grp GROUP BY ALL),
inci AS (SELECT *, 'INC-' || substr(sha256(concat_ws('|', entity, group_no, first_us)), 1, 8) AS incident_id FROM inc JOIN rk USING (entity, group_no))
"""


ACTION = "CASE main_class WHEN 'BOTNET_C2_BEACONING' THEN 'Isolate host endpoint; perform memory and process inspection for persistent C2 implant.' WHEN 'ENCRYPTED_MALWARE' THEN 'Correlate host process hash with JA3/JA4 fingerprint and terminate suspect process.' ELSE 'Apply traffic rate limiting and upstream filter rules at gateway edge.' END"


@query("incidents", INC + f"SELECT incident_id, entity, first_us, last_us, stages, array_to_string(list_filter(texts, lambda x, i: list_position(texts, x) = i), '; ') AS evidence, main_class, {ACTION} AS recommended_action, CAST({_fixed('risk', 6)} AS DOUBLE) AS risk, {RISK_SEVERITY} AS severity FROM inci")
def incidents(spark, d):
    i = incidents_of(grouped(spark, d))
    return i.select("incident_id", "entity", us("first_seen", "first_us"), us("last_seen", "last_us"), F.array_join("stages", ",").alias("stages"), F.array_join("evidence_items", "; ").alias("evidence"), "main_class", "recommended_action", F.round(C.told(F.col("risk")), 6).alias("risk"), "severity")


@query("incident_timeline", GROUPS + f"SELECT entity, group_no, CAST(row_number() OVER (PARTITION BY entity, group_no ORDER BY us, o) AS INTEGER) AS place, us, threat_class, {STAGE} AS stage FROM grp")
def incident_timeline(spark, d):
    return C.incident_timeline(grouped(spark, d)).select("entity", "group_no", "place", us("ts"), "threat_class", "stage")


@query("incident_evidence", GROUPS + f""", x AS (SELECT entity, group_no, {TEXT} AS text, count(*) AS times, min((us, o)) AS first, min(us) AS first_us FROM grp GROUP BY ALL)
SELECT entity, group_no, CAST(row_number() OVER (PARTITION BY entity, group_no ORDER BY first, text) AS INTEGER) AS place, text, times, first_us FROM x""")
def incident_evidence(spark, d):
    g = grouped(spark, d).select("entity", "group_no", "ts", "detector_order", "threat_class", "detector_type", "confidence", "zscore")
    return C.incident_evidence(g.withColumn("evidence", C.evidence_items(g.columns))).select("entity", "group_no", "place", "text", "times", us("first_ts", "first_us"))


@query("compact_incidents", INC + f"SELECT incident_id, entity, first_us, last_us, signals AS n_stages, main_class, {ACTION} AS recommended_action, round(risk, 6) AS risk, {RISK_SEVERITY} AS severity FROM inci")
def compact_incidents(spark, d):
    i = C.build_incidents(grouped(spark, d), listed=False)
    return i.select("incident_id", "entity", us("first_seen", "first_us"), us("last_seen", "last_us"), "n_stages", "main_class", "recommended_action", F.round("risk", 6).alias("risk"), "severity")


@query("alerts", INC + "SELECT seq, o AS detector_order, 'ALT-' || substr(sha256(concat_ws('|', entity, us, o)), 1, 8) AS alert_id, incident_id FROM grp JOIN inci USING (entity, group_no)")
def alerts(spark, d):
    g = grouped_once(spark, d)
    return C.build_alerts(g, incidents_of(g)).select("seq", "detector_order", "alert_id", "incident_id")


@query("latest_alerts", SIG + "SELECT seq, o AS detector_order, us FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO' ORDER BY us DESC, seq, o LIMIT 25")
def latest_alerts(spark, d):
    a = C.build_alerts(D.active_signals(signals(spark, d))).withColumn("tie", F.format_string("%012d-%d", "seq", "detector_order"))
    return C.latest(a, 25, tie="tie").select("seq", "detector_order", us("ts"))


@query("evidence", RECON + "SELECT src_ip, 'RECON_PORT_SCAN' AS threat_class, 'Rapid port discovery sweep: ' || ports || ' unique ports; High destination fan-out: ' || ips || ' target IPs' AS evidence, 'Inspect source host for unauthorized discovery utilities or scanning tools.' AS action FROM r")
def evidence(spark, d):
    s = D.detect(X.recon_features(V.flows(spark, d), ["src_ip"], 30 * DAY), "recon").withColumn("detector_type", F.lit("DETERMINISTIC_BASELINE"))
    return s.select("src_ip", "threat_class", F.array_join(C.evidence_items(s.columns), "; ").alias("evidence"), C.recommended_action().alias("action"))


EDGE = SIG + """, act AS (SELECT *, 'sig-' || substr(sha256(concat_ws('|', seq, o)), 1, 8) AS sid FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO'),
ed AS (SELECT entity AS src, sid AS dst, 'GENERATED_SIGNAL' AS type, us FROM act UNION ALL SELECT entity, target, 'COMMUNICATES_WITH', us FROM act UNION ALL SELECT sid, target, 'TARGETED_BY', us FROM act)
"""


def edges_of(spark, d):
    return G.signal_edges(D.active_signals(signals(spark, d)))


@query("signal_graph", EDGE + "SELECT src, dst, type, count(*) AS weight, min(us) AS first_us, max(us) AS last_us FROM ed GROUP BY ALL")
def signal_graph(spark, d):
    return G.distinct_edges(edges_of(spark, d)).select("src", "dst", "type", "weight", us("first_ts"), us("last_ts"))


#: Nodes within three hops, each hop from the nodes of the hop before.
HOPS = """
WITH f AS (SELECT src_ip AS src, dst_ip AS dst FROM flows WHERE seq % 40 = 0 OR src_ip = '10.0.0.1'), e AS (SELECT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f),
h0 AS (SELECT '10.0.0.1' AS id, 0 AS hops), h1 AS (SELECT DISTINCT b AS id, 1 AS hops FROM e JOIN h0 ON a = id WHERE b NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT b AS id, 2 AS hops FROM e JOIN h1 ON a = id WHERE b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1)),
h3 AS (SELECT DISTINCT b AS id, 3 AS hops FROM e JOIN h2 ON a = id WHERE b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2)),
h AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
"""


def some_edges(spark, d):
    return V.flows(spark, d).where("seq % 40 = 0 or src_ip = '10.0.0.1'").select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))


@query("k_hop_subgraph", HOPS + "SELECT * FROM h")
def k_hop_subgraph(spark, d):
    return G.k_hop_subgraph(some_edges(spark, d), "10.0.0.1", 3)


@query("k_hop_edges", HOPS + "SELECT DISTINCT src, dst FROM f WHERE src IN (SELECT id FROM h WHERE hops < 3) OR dst IN (SELECT id FROM h WHERE hops < 3)")
def k_hop_edges(spark, d):
    e = some_edges(spark, d)
    return G.k_hop_edges(e, G.k_hop_subgraph(e, "10.0.0.1", 3), 3)


@query("incident_graph", INC + ", a AS (SELECT entity, 'sig-' || substr(sha256(concat_ws('|', seq, o)), 1, 8) AS sid, incident_id, us FROM grp JOIN inci USING (entity, group_no)), e AS (SELECT entity AS src, incident_id AS dst, us FROM a UNION ALL SELECT sid, incident_id, us FROM a) SELECT src, dst, 'PART_OF_INCIDENT' AS type, count(*) AS weight FROM e GROUP BY ALL")
def incident_graph(spark, d):
    g = grouped_once(spark, d)
    return G.distinct_edges(G.incident_edges(incidents_of(g), g)).select("src", "dst", "type", "weight")


@query("pruned_graph", EDGE + """, nd AS (SELECT src AS id, us FROM ed UNION ALL SELECT dst, us FROM ed), t AS (SELECT id, max(us) AS u FROM nd GROUP BY ALL ORDER BY u DESC, id LIMIT 200)
SELECT DISTINCT src, dst, type FROM ed WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""")
def pruned_graph(spark, d):
    s = D.active_signals(signals(spark, d))
    return G.prune_graph(G.signal_nodes(s), edges_of(spark, d), 200)[1].select("src", "dst", "type").distinct()


#: Events of sources and of destinations, in three captures.
TRUE_ENDS = "g AS (SELECT CASE WHEN event_order % 5 = 0 THEN '198.51.100.' || (event_order % 4) ELSE entity END AS entity, threat_class, lo, hi, event_order, event_order % 3 AS capture_id FROM gt)"


def both_ends(spark, d):
    n = F.col("event_order")
    return V.gt_events(spark, d).withColumns({"entity": F.when(n % 5 == 0, F.concat(F.lit("198.51.100."), (n % 4).cast("string"))).otherwise(F.col("entity")), "capture_id": n % 3})


@query("align_ground_truth", f"""
WITH {TRUE_ENDS}, h AS (SELECT p.seq, arg_min(g.threat_class, g.event_order) AS truth FROM packets p JOIN g ON g.entity IN (p.src_ip, p.dst_ip) AND p.us BETWEEN g.lo - 5000000 AND g.hi + 5000000 GROUP BY ALL)
SELECT p.seq AS decision_id, coalesce(h.truth, 'BENIGN') AS truth FROM packets p LEFT JOIN h USING (seq)""")
def align_ground_truth(spark, d):
    p = V.packets(spark, d).select(F.col("seq").alias("decision_id"), "ts", F.col("src_ip").alias("entity"), F.col("dst_ip").alias("peer"))
    return E.align_ground_truth(p, both_ends(spark, d)).select("decision_id", "truth")


@query("events_overlapping", """
WITH w AS (SELECT i AS window_no, 1704067200000000 + i * 21600000000 AS s, 1704067200000000 + i * 21600000000 + 3600000000 AS t FROM (SELECT DISTINCT (us - 1704067200000000) // 21600000000 AS i FROM base))
SELECT event_order, window_no FROM gt JOIN w ON greatest(lo, s) <= least(hi, t)""")
def events_overlapping(spark, d):
    n = F.floor((F.unix_micros("ts") - 1704067200000000) / 21600000000)
    w = V.base(spark, d).select(n.alias("window_no")).distinct()
    start = F.col("window_no") * 21600000000 + 1704067200000000
    w = w.withColumns({"window_start": F.timestamp_micros(start), "window_end": F.timestamp_micros(start + 3600000000)})
    return E.events_overlapping(V.gt_events(spark, d), w).select("event_order", "window_no")


CM = "WITH c AS (SELECT unnest(['BENIGN', 'THREAT', 'OTHER']) AS name), cm AS (SELECT t.name AS truth, p.name AS predicted, count(decision_id) AS n FROM c t CROSS JOIN c p LEFT JOIN decisions d ON d.truth = t.name AND d.predicted = p.name GROUP BY ALL), tot AS (SELECT sum(n) AS total FROM cm), m AS (SELECT name, CAST(sum(n) FILTER (truth = name AND predicted = name) AS BIGINT) AS tp, CAST(sum(n) FILTER (truth <> name AND predicted = name) AS BIGINT) AS fp, CAST(sum(n) FILTER (truth = name AND predicted <> name) AS BIGINT) AS fn FROM c, cm GROUP BY ALL), m2 AS (SELECT *, CAST(total - tp - fp - fn AS BIGINT) AS tn, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM m, tot), m3 AS (SELECT *, fp / nullif(fp + tn, 0) AS fpr, 2 * p * r / nullif(p + r, 0) AS f1 FROM m2)"


def cm_of(spark, d):
    classes = spark.createDataFrame([("BENIGN",), ("THREAT",), ("OTHER",)], "name string")
    return E.confusion_matrix(V.decisions(spark, d), classes)


@query("confusion_matrix", CM + "SELECT truth, predicted, n FROM cm")
def confusion_matrix(spark, d):
    return cm_of(spark, d)


@query("class_metrics", CM + "SELECT name, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, CASE WHEN tp + fn > 0 THEN 'TESTED' ELSE 'NOT_TESTED' END AS status FROM m3")
def class_metrics(spark, d):
    return rounded(E.class_metrics(cm_of(spark, d)).select("name", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "status"))


@query("summary_metrics", CM + "SELECT round(avg(p) FILTER (name <> 'BENIGN'), 6) AS macro_precision, round(avg(r) FILTER (name <> 'BENIGN'), 6) AS macro_recall, round(avg(f1) FILTER (name <> 'BENIGN'), 6) AS macro_f1, round(1 - max(r) FILTER (name = 'BENIGN'), 6) AS benign_false_alarm_rate, round(max(fpr) FILTER (name = 'BENIGN'), 6) AS threat_miss_rate FROM m3")
def summary_metrics(spark, d):
    return rounded(E.summary_metrics(E.class_metrics(cm_of(spark, d))))


@query("binary_anomaly", "WITH c AS (SELECT count(*) FILTER (truth <> 'BENIGN' AND predicted <> 'BENIGN') AS tp, count(*) FILTER (truth = 'BENIGN' AND predicted <> 'BENIGN') AS fp, count(*) FILTER (truth <> 'BENIGN' AND predicted = 'BENIGN') AS fn, count(*) FILTER (truth = 'BENIGN' AND predicted = 'BENIGN') AS tn FROM decisions) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_alarm_rate, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def binary_anomaly(spark, d):
    return rounded(E.binary_anomaly_metrics(V.decisions(spark, d)))


@query("latency_percentiles", "WITH n AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i FROM decisions) SELECT count(*) AS total, median(latency) AS median, max(latency) FILTER (i = (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM decisions)) AS p95 FROM n")
def latency_percentiles(spark, d):
    return E.latency_percentiles(V.decisions(spark, d)).select("total", "median", "p95")


@query("score_distribution", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(CAST(n_chars AS DOUBLE)) AS min, max(CAST(n_chars AS DOUBLE)) AS max, " + ", ".join(f"round(quantile_cont(CAST(n_chars AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM documents GROUP BY ALL", views=False)
def score_distribution(spark, d):
    docs = V.read(spark, d, "documents").withColumn("score", F.col("n_chars").cast("double"))
    return rounded(E.score_distribution(docs, ["lang"]))


@query("threshold_sweep", """
WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS score, toxic = 1 AS bad FROM documents JOIN labels USING (doc_id)), q AS (SELECT quantile_cont(score, [0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]) AS t FROM s),
u AS (SELECT [1, 5, 10, 15, 20, 25, 30][i] AS pct, t[i] AS threshold FROM q, (SELECT unnest(range(1, 8)) AS i)),
c AS (SELECT pct, threshold, count(*) FILTER (score <= threshold AND bad) AS tp, count(*) FILTER (score <= threshold AND NOT bad) AS fp, count(*) FILTER (score > threshold AND bad) AS fn, count(*) FILTER (score > threshold AND NOT bad) AS tn FROM s, u GROUP BY ALL)
SELECT pct, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(1 - tp / nullif(tp + fn, 0), 6) AS fnr, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""", views=False)
def threshold_sweep(spark, d):
    s = V.read(spark, d, "documents").join(V.read(spark, d, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("is_attack"))
    return rounded(E.threshold_sweep(s))


ITEMS = "li AS (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM lineitem)"


def items(spark, d):
    k = F.col("l_orderkey") % 3
    return V.read(spark, d, "lineitem").withColumn("split", F.when(k == 0, "train").when(k == 1, "val").otherwise("test"))


@query("class_balance", f"WITH {ITEMS} SELECT split, l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM li GROUP BY split, l_returnflag", views=False)
def class_balance(spark, d):
    return rounded(E.class_balance(items(spark, d), "l_returnflag"))


@query("class_feature_stats", """
WITH l AS (SELECT l_returnflag AS label, unnest([{'feature': 'l_quantity', 'value': CAST(l_quantity AS DOUBLE)}, {'feature': 'l_discount', 'value': CAST(l_discount AS DOUBLE)}]) AS p FROM lineitem)
SELECT p.feature AS feature, label, round(avg(p.value), 6) AS mean, round(stddev_samp(p.value), 6) AS std, round(quantile_cont(p.value, 0.1), 6) AS p10, round(quantile_cont(p.value, 0.5), 6) AS median, round(quantile_cont(p.value, 0.9), 6) AS p90 FROM l GROUP BY ALL""", views=False)
def class_feature_stats(spark, d):
    return rounded(E.class_feature_stats(V.read(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))


@query("category_concentration", "WITH c AS (SELECT l_linestatus AS category, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL) SELECT category, CAST(sum(n) AS BIGINT) AS active, arg_max(label, (n, label)) AS dominant, round(100.0 * max(n) / sum(n), 6) AS dominant_pct, 100.0 * max(n) / sum(n) > 70 AS concentrated FROM c GROUP BY category", views=False)
def category_concentration(spark, d):
    return rounded(E.category_concentration(V.read(spark, d, "lineitem"), "l_linestatus", "l_returnflag"))


@query("mutual_information", """
WITH l AS (SELECT l_returnflag AS label, unnest([{'f': 'l_quantity', 'v': CAST(l_quantity AS DOUBLE)}, {'f': 'l_extendedprice', 'v': CAST(l_extendedprice AS DOUBLE)}]) AS p FROM lineitem),
e AS (SELECT p.f AS feature, min(p.v) AS lo, max(p.v) AS hi FROM l GROUP BY ALL), c AS (SELECT feature, label, least(9, floor((p.v - lo) / ((hi - lo) / 10))) AS bin, count(*) AS n FROM l JOIN e ON p.f = feature GROUP BY ALL),
z AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS total FROM c)
SELECT feature, round(sum(n / total * log2(n * total / (nb * nl))), 6) AS mi, sum(n / total * log2(n * total / (nb * nl))) > 0.85 * max(sum(n / total * log2(n * total / (nb * nl)))) OVER () AS flagged FROM z GROUP BY feature""", views=False)
def mutual_information(spark, d):
    return rounded(E.mutual_information(V.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag").select("feature", "mi", "flagged"))


PSI = "(ln({0} + 6.0) - 1 / (2 * ({0} + 6.0)) - 1 / (12 * ({0} + 6.0) ** 2) + 1 / (120 * ({0} + 6.0) ** 4) - 1 / (252 * ({0} + 6.0) ** 6) - 1.0 / {0} - 1 / ({0} + 1.0) - 1 / ({0} + 2.0) - 1 / ({0} + 3.0) - 1 / ({0} + 4.0) - 1 / ({0} + 5.0))"


@query("neighbour_information", f"""
WITH l AS (SELECT vec_id AS id, label, unnest([{{'f': 'x0', 'x': CAST(embedding[1] AS DOUBLE)}}, {{'f': 'x1', 'x': CAST(embedding[2] AS DOUBLE)}}, {{'f': 'tens', 'x': CAST(vec_id // 10 AS DOUBLE)}}, {{'f': 'label', 'x': CAST(label AS DOUBLE)}}]) AS p FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY p.f, label) AS size FROM l),
n AS (SELECT a.p.f AS f, a.id, a.p.x AS x, a.size, row_number() OVER (PARTITION BY a.p.f, a.id ORDER BY abs(b.p.x - a.p.x)) AS k, abs(b.p.x - a.p.x) AS d FROM s a JOIN s b ON a.p.f = b.p.f AND a.label = b.label AND a.id <> b.id),
r AS (SELECT f, id, x, size, least(3, size - 1) AS k, d FROM n WHERE k = least(3, size - 1)),
m AS (SELECT r.f, r.id, any_value(r.k) AS k, any_value(r.size) AS size, count(*) AS m FROM r JOIN r b ON b.f = r.f AND CASE WHEN r.d = 0 THEN b.x = r.x ELSE b.x > r.x - r.d AND b.x < r.x + r.d END GROUP BY ALL)
SELECT f AS feature, round(greatest(0, {PSI.format('count(*)')} + avg({PSI.format('k')}) - avg({PSI.format('size')}) - avg({PSI.format('m')})), 6) AS mi FROM m GROUP BY f""", views=False)
def neighbour_information(spark, d):
    v = V.read(spark, d, "embeddings")
    v = v.select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].alias("x0"), F.col("embedding")[1].alias("x1"), F.floor(F.col("vec_id") / 10).alias("tens"))
    wide = v.withColumn("label_", F.col("label"))
    found = E.neighbour_information(wide, ["x0", "x1", "tens", "label_"], "label", sample=None)
    return found.select(F.regexp_replace("feature", "_$", "").alias("feature"), F.round("mi", 6).alias("mi"))


@query("split_overlap", f"WITH {ITEMS} SELECT l_partkey FROM li WHERE split = 'train' INTERSECT SELECT l_partkey FROM li WHERE split = 'test'", views=False)
def split_overlap(spark, d):
    li = items(spark, d)
    return E.split_overlap(li.where("split = 'train'"), li.where("split = 'test'"), "l_partkey")


@query("entity_leakage", f"WITH {ITEMS} SELECT l_suppkey, count(DISTINCT split) AS splits FROM li GROUP BY ALL HAVING count(DISTINCT split) > 1", views=False)
def entity_leakage(spark, d):
    return E.entity_leakage(items(spark, d), "l_suppkey")


@query("class_centroids", "SELECT l_returnflag, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS l_quantity, round(avg(CAST(l_discount AS DOUBLE)), 6) AS l_discount FROM lineitem GROUP BY ALL", views=False)
def class_centroids(spark, d):
    df = V.read(spark, d, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_discount")})
    return rounded(E.class_centroids(df, ["l_quantity", "l_discount"], "l_returnflag"))


@query("manifest_summary", "WITH c AS (SELECT o_orderpriority AS traffic_class, o_orderstatus AS split, 1 AS events FROM orders) SELECT traffic_class, split, count(*) AS captures, CAST(sum(events) AS BIGINT) AS events FROM c GROUP BY GROUPING SETS ((traffic_class), (split), ())", views=False)
def manifest_summary(spark, d):
    return E.manifest_summary(V.read(spark, d, "orders").select(F.col("o_orderpriority").alias("traffic_class"), F.col("o_orderstatus").alias("split"), F.lit(1).alias("events")))


@query("detection_by_condition", "SELECT CAST(latency AS BIGINT) % 5 AS level, CASE WHEN bool_or(predicted = truth) THEN 'DETECTED' ELSE 'EVADED' END AS outcome, count(*) AS signals FROM decisions GROUP BY ALL")
def detection_by_condition(spark, d):
    x = V.decisions(spark, d).withColumns({"level": F.col("latency").cast("long") % 5, "expected": F.col("truth")})
    return E.detection_by_condition(x, ["level"])


@query("top_confusions", CM + "SELECT truth, predicted, n FROM cm WHERE truth <> predicted AND n > 0 ORDER BY n DESC, truth, predicted LIMIT 5")
def top_confusions(spark, d):
    return E.top_confusions(cm_of(spark, d))


@query("preprocess", """
WITH m AS (SELECT quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS q FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS DOUBLE) END, q) AS l_quantity, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R" FROM lineitem, m""", views=False)
def preprocess(spark, d):
    li = items(spark, d)
    state = M.fit_preprocessor(li.where("split = 'train'"), ["l_quantity"], ["l_returnflag"])
    return M.apply_preprocessor(li.withColumn("l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))), state, ["l_orderkey", "l_linenumber"])


@query("validate_features", "SELECT 'l_quantity' AS \"column\", 'missing' AS problem, CAST(1 AS BIGINT) AS n FROM lineitem WHERE false UNION ALL SELECT 'label', 'label out of range', count(*) FROM lineitem WHERE l_linenumber > 6 HAVING count(*) > 0", views=False)
def validate_features(spark, d):
    li = V.read(spark, d, "lineitem").withColumn("label", F.col("l_linenumber"))
    return M.validate_features(li, ["l_quantity", "l_discount"], ("is_attack",), "label", 7)


def vectors(spark, d):
    """The labelled embeddings, a column for each component, and the columns' names."""
    e = V.read(spark, d, "embeddings").where("label is not null")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(width)]
    return e.select(F.col("vec_id").alias("id"), "label", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names))), names


@query("forest_predictions")
def forest_predictions(spark, d):
    v, xs = vectors(spark, d)
    model = M.train_forest(v.where("id % 5 <> 0"), xs, trees=20, depth=8)
    return M.predict_classes(model, v, xs).select("id", "label", "class_index", F.round("class_confidence", 6).alias("confidence"), "is_threat")


@query("boosted_predictions")
def boosted_predictions(spark, d):
    v, xs = vectors(spark, d)
    models = M.train_boosted(v.where("id % 5 <> 0"), xs, rounds=5, depth=3)
    return M.predict_boosted(models, v, xs).select("id", "label", "class_index", F.round("class_confidence", 6).alias("confidence"))


@query("anomaly_scores")
def anomaly_scores(spark, d):
    v, xs = vectors(spark, d)
    return M.anomaly_scores(M.train_isolation_forest(v, xs, trees=50), v).select("id", F.round("decision", 6).alias("decision"), "is_anomaly", "anomaly_confidence")


@query("cross_validate")
def cross_validate(spark, d):
    v, xs = vectors(spark, d)
    return M.cross_validate(v, xs, k=3, trees=10, depth=5)


@query("combine_ml")
def combine_ml(spark, d):
    v, xs = vectors(spark, d)
    v = v.withColumnRenamed("id", "sample_id")
    model = M.train_forest(v, xs, trees=10, depth=5)
    # the table has more labels than there are threats: those beyond go by their number
    names = F.coalesce(F.try_element_at(F.array(*map(F.lit, M.CLASS_NAMES)), F.col("class_index") + 1), F.concat(F.lit("CLASS_"), F.col("class_index").cast("string")))
    classified = M.predict_classes(model, v, xs).select("sample_id", "class_index", "class_confidence").withColumn("class_name", names)
    odd = M.anomaly_scores(M.train_isolation_forest(v.withColumnRenamed("sample_id", "id"), xs, trees=20), v).select("sample_id", "is_anomaly", "anomaly_confidence")
    return C.combine_ml(classified, odd).select("sample_id", "threat_class", "detector_type", F.round("confidence", 6).alias("confidence"), "severity")


@query("combine_verdicts", f"""
WITH x AS (SELECT doc_id AS sample_id, doc_id % 7 AS class_index, n_chars % 101 / 100 AS class_confidence, n_chars % 3 = 0 AS is_anomaly, n_chars % 53 / 52 AS anomaly_confidence FROM documents),
c AS (SELECT sample_id, CASE WHEN class_index > 0 THEN ['BENIGN', 'VOLUMETRIC_DDOS', 'BOTNET_C2_BEACONING', 'DGA_DNS_TUNNELLING', 'ENCRYPTED_MALWARE', 'RECON_PORT_SCAN', 'DATA_EXFILTRATION'][class_index + 1] ELSE 'UNKNOWN_ANOMALY' END AS threat_class, CASE WHEN class_index > 0 THEN 'LIGHTWEIGHT_ML' ELSE 'UNSUPERVISED_ANOMALY' END AS detector_type,
  CASE WHEN class_index > 0 THEN class_confidence ELSE anomaly_confidence END AS confidence FROM x WHERE class_index > 0 OR is_anomaly)
SELECT sample_id, threat_class, detector_type, confidence, {_band('confidence')} AS severity FROM c""", views=False)
def combine_verdicts(spark, d):
    docs, n = V.read(spark, d, "documents"), F.col("doc_id")
    names = F.element_at(F.array(*map(F.lit, M.CLASS_NAMES)), (n % 7 + 1).cast("int"))
    classified = docs.select(n.alias("sample_id"), (n % 7).alias("class_index"), names.alias("class_name"), (F.col("n_chars") % 101 / 100).alias("class_confidence"))
    odd = docs.select(n.alias("sample_id"), (F.col("n_chars") % 3 == 0).alias("is_anomaly"), (F.col("n_chars") % 53 / 52).alias("anomaly_confidence"))
    return C.combine_ml(classified, odd).select("sample_id", "threat_class", "detector_type", "confidence", "severity")


@query("entity_events", SIG + """, w AS (SELECT entity, seq, us, pps, avg(pps) OVER h AS m, coalesce(stddev_samp(pps) OVER h, 0) AS sd FROM ctx WINDOW h AS (PARTITION BY entity ORDER BY us, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
z AS (SELECT entity, round(arg_max(CASE WHEN sd >= 0.00001 THEN greatest(0, (pps - m) / sd) WHEN m > 0 THEN greatest(0, (pps - m) / greatest(m, 1)) WHEN pps <= 10 THEN 0 ELSE pps / 10 END, (us, seq)), 3) AS zscore, count(*) AS observations FROM w GROUP BY ALL),
k AS (SELECT src_ip AS entity, count(DISTINCT dst_ip) AS known_destinations FROM flows GROUP BY ALL), a AS (SELECT entity, count(*) AS n FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO' GROUP BY ALL)
SELECT entity, zscore, observations, known_destinations, 0 AS new_destinations, coalesce(n, 0) AS active_signals FROM z LEFT JOIN k USING (entity) LEFT JOIN a USING (entity)""")
def entity_events(spark, d):
    return R.entity_events(V.contexts(spark, d), V.flows(spark, d), signals(spark, d)).drop("last_is_new")


@query("batch_entity_features", EXFIL.replace("FROM flows", "FROM fl").replace("WITH e AS", "WITH fl AS (SELECT * FROM flows WHERE us >= 1704067200000000 AND us < 1705276800000000), e AS") + "SELECT entity, flow_count, outbound_bytes, inbound_bytes, destinations, round(outbound_bytes / 1209600, 6) AS outbound_rate, r.ports AS unique_dst_ports FROM x LEFT JOIN (SELECT src_ip AS entity, count(DISTINCT dst_port) AS ports FROM fl GROUP BY ALL) r USING (entity)")
def batch_entity_features(spark, d):
    from datetime import UTC, datetime

    b = X.batch_entity_features(V.flows(spark, d), datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 15, tzinfo=UTC))
    return b.select("entity", "flow_count", "outbound_bytes", "inbound_bytes", "destinations", F.round("outbound_rate", 6).alias("outbound_rate"), "unique_dst_ports")


FLOW = "PARTITION BY src_ip, dst_ip, dst_port, protocol, session ORDER BY us, seq"
FAILED = {"reset": "fbytes = 0 OR (frst > 0 AND fbytes < 64)", "half_open": "fbytes = 0 OR (fsyn > 0 AND fack = 0)"}


def _packet_contexts(rule: str) -> str:
    return SESSIONS + f""", p1 AS (
  SELECT *, count(*) OVER w AS observations, sum(packet_length) OVER w AS fbytes, sum(tcp_syn) OVER w AS fsyn, sum(tcp_ack) OVER w AS fack, sum(tcp_rst) OVER w AS frst, min(us) OVER w AS start_us, (us - lag(us) OVER ({FLOW})) / 1000 AS iat
  FROM s WINDOW w AS ({FLOW} ROWS UNBOUNDED PRECEDING)
),
p2 AS (
  SELECT *, count(iat) OVER w AS iats, avg(iat) OVER w AS mean, stddev_pop(iat) OVER w AS std, CAST({FAILED[rule]} AS INTEGER) AS failed_now,
         CAST(row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY us, seq) = 1 AS INTEGER) AS new_ip, CAST(row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY us, seq) = 1 AS INTEGER) AS new_port
  FROM p1 WINDOW w AS ({FLOW} ROWS UNBOUNDED PRECEDING)
),
p3 AS (SELECT *, failed_now - coalesce(lag(failed_now) OVER ({FLOW}), 0) AS change FROM p2),
p4 AS (
  SELECT seq, us, src_ip AS entity, dst_ip AS target, true AS outbound, packet_length, observations, fbytes, fsyn, start_us, iats, mean, std, new_ip, new_port, CAST(observations = 1 AS INTEGER) AS new_flow, change FROM p3
  UNION ALL SELECT seq, us, dst_ip, NULL, false, packet_length, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 0 FROM p3
),
p5 AS (
  SELECT *, sum(new_flow) OVER w AS flow_count, sum(new_ip) OVER w AS ips, sum(new_port) OVER w AS ports, sum(change) OVER w AS failed, sum(CASE WHEN outbound THEN packet_length ELSE 0 END) OVER w AS outbound_bytes,
         sum(CASE WHEN outbound THEN 0 ELSE packet_length END) OVER w AS inbound_bytes, min(CASE WHEN outbound THEN us END) OVER w AS first_us
  FROM p4 WINDOW w AS (PARTITION BY entity ORDER BY us, seq, outbound DESC ROWS UNBOUNDED PRECEDING)
),
pc AS (
  SELECT seq, us, entity, target, observations, coalesce(observations / nullif((us - start_us) / 1e6, 0), 0) AS pps, coalesce(fbytes / nullif((us - start_us) / 1e6, 0), 0) AS bps, new_ip = 1 AS is_new_destination, fsyn / observations AS syn_ratio,
         CASE WHEN iats >= 3 THEN CASE WHEN mean = 0 THEN 0 ELSE std / mean * 100 END END AS jitter, flow_count, ips, ports, failed, outbound_bytes, inbound_bytes, greatest(1.0, (us - first_us) / 1e6) AS life
  FROM p5 WHERE outbound
),
pd AS (SELECT *, CASE WHEN jitter IS NOT NULL THEN greatest(0, least(1, 1 - jitter / 50)) END AS periodicity, CASE WHEN inbound_bytes > 0 THEN outbound_bytes / greatest(1.0, inbound_bytes) WHEN outbound_bytes > 10000 THEN 100.0 ELSE 1.0 END AS ratio FROM pc),
pe AS (
  SELECT *, {DDOS} AS c_ddos, {C2_CONF} AS c_c2, 0.35 * {_ramp('ips', 3.0, 30.0)} + 0.35 * {_ramp('ports', 5.0, 100.0)} + 0.2 * {_ramp('flow_count / life', 0.5, 20.0)} + 0.1 * {_ramp('failed / flow_count', 0.3, 0.9)} AS s_recon,
         0.35 * {_ramp('outbound_bytes', 1e7, 5e8)} + 0.3 * {_ramp('outbound_bytes / life', 1e5, 1e7)} + 0.25 * {_ramp('ratio', 2.0, 50.0)} AS s_exfil, avg(pps) OVER h AS m, coalesce(stddev_samp(pps) OVER h, 0) AS sd
  FROM pd WINDOW h AS {ZWINDOW}
),
pf AS (SELECT *, {ZSCORE} AS z, CASE WHEN flow_count >= 3 THEN s_recon * 0.9 ELSE 0.1 END AS c_recon, CASE WHEN flow_count >= 3 THEN s_exfil * 0.9 ELSE 0 END AS c_exfil FROM pe),
ps AS (
  SELECT seq, us, entity, 0 AS o, 'VOLUMETRIC_DDOS' AS threat_class, c_ddos AS confidence, CASE WHEN c_ddos >= 0.9 THEN 'CRITICAL' ELSE {_band('c_ddos')} END AS severity, z, 'DETERMINISTIC_BASELINE' AS dt FROM pf
  UNION ALL SELECT seq, us, entity, 1, 'BOTNET_C2_BEACONING', c_c2, {_band('c_c2')}, z, 'DETERMINISTIC_BASELINE' FROM pf
  UNION ALL SELECT seq, us, entity, 2, 'RECON_PORT_SCAN', c_recon, CASE WHEN flow_count >= 3 THEN {_band('c_recon')} ELSE 'INFO' END, z, 'DETERMINISTIC_BASELINE' FROM pf
  UNION ALL SELECT seq, us, entity, 3, 'DATA_EXFILTRATION', c_exfil, {_band('c_exfil')}, z, 'DETERMINISTIC_BASELINE' FROM pf
)
"""


ALL_RULES = ["ddos", "c2", "recon", "exfil"]


@query("packet_contexts", _packet_contexts("reset") + "SELECT seq, entity, target, observations, round(pps, 9) AS pps, round(syn_ratio, 6) AS syn_ratio, round(jitter, 6) AS jitter, round(periodicity, 6) AS periodicity, CAST(flow_count AS BIGINT) AS flow_count, CAST(ips AS BIGINT) AS unique_dst_ips, CAST(ports AS BIGINT) AS unique_dst_ports, round(failed / flow_count, 6) AS failed_ratio, round(flow_count / life, 9) AS connection_rate, CAST(outbound_bytes AS BIGINT) AS outbound_bytes, round(outbound_bytes / life, 9) AS outbound_rate, round(bps, 9) AS bytes_per_sec, is_new_destination, flow_count >= 3 AS sufficient, round(ratio, 6) AS up_down_ratio FROM pd")
def packet_contexts(spark, d):
    c = X.packet_contexts(V.packets(spark, d), 12 * H)
    six = {n: F.round(n, 6) for n in ("syn_ratio", "jitter", "periodicity", "failed_ratio", "up_down_ratio")} | {n: F.round(n, 9) for n in ("pps", "connection_rate", "outbound_rate", "bytes_per_sec")}
    return c.withColumns(six).select("seq", "entity", "target", "observations", "pps", "syn_ratio", "jitter", "periodicity", "flow_count", "unique_dst_ips", "unique_dst_ports", "failed_ratio", "connection_rate", "outbound_bytes", "outbound_rate", "bytes_per_sec", "is_new_destination", "sufficient", "up_down_ratio")


PIPE = _packet_contexts("reset") + f""", ml AS (SELECT seq, us, entity, 9 AS o, 'UNKNOWN_ANOMALY' AS threat_class, least(1, z / 10) AS confidence, {_band('least(1, z / 10)')} AS severity, z, 'UNSUPERVISED_ANOMALY' AS dt FROM pf),
act AS (SELECT * FROM (SELECT * FROM ps UNION ALL SELECT * FROM ml) WHERE confidence >= 0.1 AND severity <> 'INFO'),
grp AS (SELECT *, CAST(sum(CASE WHEN us - prev > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM (SELECT *, lag(us) OVER (PARTITION BY entity ORDER BY us, o) AS prev FROM act)),
rk AS (SELECT entity, group_no, count(*) AS signals, min(us) AS first_us, max(us) AS last_us, least(0.99, max(confidence) + least(0.25, 0.1 * (count(DISTINCT threat_class) - 1)) + CASE WHEN count(DISTINCT dt) > 1 THEN 0.1 ELSE 0 END + {FAR.format('max(z)')}) AS risk, bool_or(severity = 'CRITICAL') AS cr, bool_or(severity = 'HIGH') AS hi, arg_max(threat_class, (confidence, -us, -o)) AS main_class,
  array_to_string(list(threat_class ORDER BY us, o), ',') AS classes FROM grp GROUP BY ALL)
"""


def piped(spark, d):
    def anomalies(contexts):
        """Deviation alone as a second kind of detector."""
        c = F.least(F.lit(1.0), F.col("zscore") / 10)
        keep = ("entity", "ts", "seq", "target", "zscore")
        return contexts.select(*keep, F.lit(9).alias("detector_order"), F.lit("ok").alias("status"), F.lit("UNKNOWN_ANOMALY").alias("threat_class"), F.lit("deviation").alias("detector"), c.alias("score"), c.alias("confidence"), S.severity_band(c).alias("severity"), F.array().cast("array<string>").alias("reasons"), F.lit("UNSUPERVISED_ANOMALY").alias("detector_type"))

    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    return R.run_pipeline(V.packets(spark, d), DAY, 12 * H, ALL_RULES, anomalies, folder=folder)


@query("run_pipeline", PIPE + """SELECT 'packets' AS counter, count(*) AS n FROM packets UNION ALL SELECT 'flows', count(*) FROM f UNION ALL SELECT 'alerts', count(*) FROM grp UNION ALL SELECT 'incidents', count(*) FROM rk UNION ALL SELECT 'signals', count(*) FROM grp""")
def run_pipeline(spark, d):
    return piped(spark, d)["stats"]


RISKS = "CASE WHEN round(risk, 9) >= 0.9 OR cr THEN 'CRITICAL' WHEN round(risk, 9) >= 0.7 OR hi THEN 'HIGH' WHEN round(risk, 9) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
LIFE = "CASE x WHEN 'VOLUMETRIC_DDOS' THEN 'IMPACT_DENIAL_OF_SERVICE' WHEN 'BOTNET_C2_BEACONING' THEN 'C2_ESTABLISHMENT' WHEN 'RECON_PORT_SCAN' THEN 'RECONNAISSANCE' WHEN 'DATA_EXFILTRATION' THEN 'EXFILTRATION' ELSE 'ANOMALOUS_BEHAVIOUR' END"


@query("pipeline_incidents", PIPE + f"SELECT entity, group_no, signals, first_us, last_us, round(risk, 6) AS risk, main_class, array_to_string(list_transform(string_split(classes, ','), lambda x: {LIFE}), ',') AS stages FROM rk")
def pipeline_incidents(spark, d):
    i = piped(spark, d)["incidents"]
    return i.select("entity", "group_no", "signals", us("first_seen", "first_us"), us("last_seen", "last_us"), F.round("risk", 6).alias("risk"), "main_class", F.array_join("stages", ",").alias("stages"))


SCOPED = "WITH scoped AS (SELECT * REPLACE ((seq % 3) || '|' || src_ip AS src_ip, (seq % 3) || '|' || dst_ip AS dst_ip) FROM packets), "


@query("evaluate_captures", SCOPED + _packet_contexts("half_open").strip()[5:].replace("FROM packets", "FROM scoped") + f""", n AS (SELECT seq, us, seq % 3 AS capture_id, src_ip AS entity, dst_ip AS peer, row_number() OVER (PARTITION BY seq % 3, src_ip ORDER BY us, seq) AS no FROM packets),
k AS (SELECT capture_id, entity, peer, no, seq, us, us AS last, true AS kept FROM n WHERE no = 1 UNION ALL
  SELECT n.capture_id, n.entity, n.peer, n.no, n.seq, n.us, CASE WHEN n.us - k.last >= 43200000000 THEN n.us ELSE k.last END, n.us - k.last >= 43200000000 FROM k JOIN n ON n.entity = k.entity AND n.capture_id = k.capture_id AND n.no = k.no + 1),
t AS (SELECT seq, arg_max(threat_class, (confidence, -o)) AS predicted FROM ps WHERE confidence >= 0.1 AND severity <> 'INFO' GROUP BY ALL),
{TRUE_ENDS}, h AS (SELECT p.seq, arg_min(g.threat_class, g.event_order) AS truth FROM k p JOIN g ON g.entity IN (p.entity, p.peer) AND g.capture_id = p.capture_id AND p.us BETWEEN g.lo - 5000000 AND g.hi + 5000000 WHERE p.kept GROUP BY ALL)
SELECT k.seq AS decision_id, k.capture_id, coalesce(t.predicted, 'BENIGN') AS predicted, coalesce(h.truth, 'BENIGN') AS truth FROM k LEFT JOIN t USING (seq) LEFT JOIN h USING (seq) WHERE k.kept""")
def evaluate_captures(spark, d):
    packets = V.packets(spark, d).withColumn("capture_id", F.col("seq") % 3)
    return R.evaluate_captures(packets, both_ends(spark, d), 12 * H, flow_gap_seconds=12 * H, enabled=ALL_RULES).select("decision_id", "capture_id", "predicted", "truth")


@query("ablate_modes", SIG + """, s AS (SELECT seq, threat_class, confidence, CASE o WHEN 0 THEN 'rules' WHEN 1 THEN 'classifier' ELSE 'anomaly' END AS source FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO'),
m AS (SELECT unnest(['rules', 'classifier', 'anomaly', 'fused']) AS mode), b AS (SELECT seq, mode, arg_max(threat_class, (confidence, threat_class)) AS predicted FROM s JOIN m ON mode = source OR mode = 'fused' GROUP BY ALL),
t AS (SELECT seq, CASE WHEN event_type = 'error' THEN 'VOLUMETRIC_DDOS' ELSE 'BENIGN' END AS truth FROM base)
SELECT mode, count(*) AS decisions, count(*) FILTER (coalesce(predicted, 'BENIGN') = truth) AS correct, count(*) FILTER (truth = 'BENIGN' AND coalesce(predicted, 'BENIGN') <> 'BENIGN') AS false_alarms FROM t CROSS JOIN m LEFT JOIN b USING (seq, mode) GROUP BY mode""")
def ablate_modes(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("rules", "classifier", "anomaly"))), F.col("detector_order") + 1)
    s = D.active_signals(signals(spark, d)).select(F.col("seq").alias("decision_id"), "threat_class", "confidence", names.alias("source"))
    truth = V.base(spark, d).select(F.col("seq").alias("decision_id"), F.when(F.col("event_type") == "error", "VOLUMETRIC_DDOS").otherwise("BENIGN").alias("truth"))
    return R.ablate_modes(s, truth)


def spread(frame):
    """A detector of one's own, in pandas: how fast and how uneven an entity's packets come."""
    score = (frame["pps"] / 4000 + frame["jitter"].fillna(0) / 1000).clip(upper=1)
    return pd.DataFrame({"score": score, "confidence": score * 0.5, "reasons": [["fast"] if x > 0.4 else [] for x in score]})


@query("python_detectors", f"""
WITH d AS (SELECT *, least(1, pps / 4000 + coalesce(jitter, 0) / 1000) AS s, {DDOS} AS c_ddos FROM ctx)
SELECT seq, 0 AS detector_order, 'VOLUMETRIC_DDOS' AS threat_class, round(c_ddos, 9) AS confidence, CASE WHEN c_ddos >= 0.9 THEN 'CRITICAL' ELSE {_band('c_ddos')} END AS severity, 'ok' AS status, NULL AS reason FROM d
UNION ALL SELECT seq, 1, 'UNEVEN_SPREAD', round(s * 0.5, 9), {_band('s * 0.5')}, 'ok', CASE WHEN s > 0.4 THEN 'fast' END FROM d""")
def python_detectors(spark, d):
    own = D.PythonDetector("spread", ("pps", "jitter"), spread, "UNEVEN_SPREAD")
    s = D.run_detectors(V.contexts(spark, d), ["ddos", "spread"], (own,), keep=("seq",))
    reason = F.when(F.col("detector") == "spread", F.try_element_at("reasons", F.lit(1)))
    return s.select("seq", "detector_order", "threat_class", F.round("confidence", 9).alias("confidence"), "severity", "status", reason.alias("reason"))


@query("union_signals", SIG + "SELECT o AS source_order, count(*) AS n FROM sig WHERE o < 2 AND confidence >= 0.1 AND severity <> 'INFO' GROUP BY ALL")
def union_signals(spark, d):
    s = D.active_signals(signals(spark, d))
    return R.union_signals(s.where("detector_order = 0"), s.where("detector_order = 1")).groupBy("source_order").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_by_correctness", "SELECT predicted = truth AS correct, CAST(grouping(predicted = truth) AS TINYINT) AS overall, count(*) AS n, round(avg(latency), 6) AS mean, min(latency) AS min, max(latency) AS max FROM decisions GROUP BY ROLLUP (predicted = truth)")
def confidence_by_correctness(spark, d):
    return rounded(R.confidence_by_correctness(V.decisions(spark, d).withColumnsRenamed({"truth": "label", "latency": "confidence"})), "mean")


@query("strongest_weakest_class", CM + "SELECT arg_max(name, (f1, name)) AS strongest, arg_min(name, (f1, name)) AS weakest FROM m3 WHERE f1 IS NOT NULL")
def strongest_weakest_class(spark, d):
    return R.strongest_weakest_class(E.class_metrics(cm_of(spark, d)))


@query("importance_by_domain", "WITH i AS (SELECT l_returnflag AS feature, CAST(sum(l_quantity) AS DOUBLE) AS gain FROM lineitem GROUP BY ALL), g AS (SELECT CASE WHEN feature IN ('A', 'R') THEN 'returned' ELSE 'other' END AS family, sum(gain) AS gain FROM i GROUP BY ALL) SELECT family, round(gain, 4) AS gain, round(gain / sum(gain) OVER (), 6) AS share FROM g", views=False)
def importance_by_domain(spark, d):
    i = V.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(F.sum(F.col("l_quantity").cast("double")).alias("gain"))
    families = i.where(F.col("feature").isin("A", "R")).select("feature", F.lit("returned").alias("family"))
    out = R.importance_by_domain(i, families)
    return out.withColumns({"gain": F.round("gain", 4), "share": F.round("share", 6)})


@query("flow_events", SESSIONS + "SELECT src_ip || ':40000-' || dst_ip || ':' || dst_port || '-' || protocol AS flow_id, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS start_time_iso, strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS end_time_iso, packet_count, byte_count, CASE WHEN protocol = 6 THEN syn_count END AS syn FROM f")
def flow_events(spark, d):
    return L.normalize_flow_events(built(spark, d)).select("flow_id", "start_time_iso", "end_time_iso", "packet_count", "byte_count", F.col("tcp_flags.syn").alias("syn"))


@query("flow_events_json", SESSIONS + """SELECT '{"byte_count":' || byte_count || ',"dst_ip":"' || dst_ip || '","packet_count":' || packet_count || ',"src_ip":"' || src_ip || '"}' AS json FROM f""")
def flow_events_json(spark, d):
    return T.as_json(built(spark, d).select("src_ip", "dst_ip", "packet_count", "byte_count"))


@query("captures_by", "SELECT o_orderkey AS capture_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'", views=False)
def captures_by(spark, d):
    c = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_orderpriority").alias("primary_label"), F.col("o_orderstatus").alias("split"))
    return T.captures_by(c, primary_label="1-URGENT", split="F").select("capture_id")


@query("labeled_splits", f"WITH {ITEMS} SELECT split, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS least FROM li GROUP BY ALL", views=False)
def labeled_splits(spark, d):
    """The line items by split, written as CSV and read back under their schema."""
    folder = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    li = items(spark, d)
    for s in ("train", "val", "test"):
        li.where(F.col("split") == s).select(F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("double").alias("quantity")).write.option("header", True).csv(f"{folder}/{s}.csv")
    back = T.read_labeled_splits(spark, folder, "line long, quantity double")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.min("quantity").alias("least"))


@query("manifest_events", """
WITH c AS (SELECT k % 7 AS capture_id, min(us) AS c0, max(us) AS c1 FROM base GROUP BY ALL),
e AS (SELECT k % 7 AS capture_id, seq, us AS s, us + 7200000000 AS t, row_number() OVER (PARTITION BY k % 7 ORDER BY seq) - 1 AS event_order FROM base WHERE event_type = 'error')
SELECT CAST(capture_id AS VARCHAR) AS capture_id, CAST(event_order AS INTEGER) AS event_order, CAST(seq AS VARCHAR) AS event_id, s AS start_us, t AS end_us, CASE WHEN t > c1 THEN 'event outside its capture' END AS problem FROM e JOIN c USING (capture_id)""")
def manifest_events(spark, d):
    """A manifest of seven captures over the events, written as JSON, read back and held to its own bounds."""
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    b = V.base(spark, d).withColumn("capture_id", (F.col("k") % 7).cast("string"))
    span = F.struct(iso(F.col("ts")).alias("start_time_iso"), iso(F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_time_iso"))
    event = F.struct("seq", F.col("seq").cast("string").alias("event_id"), F.lit("RECON").alias("traffic_class"), F.array("host").alias("source_ips"), span.alias("time_window"))
    listed = F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", event)))
    by = b.groupBy("capture_id").agg(F.struct(F.lit("RECON").alias("primary_label"), F.lit("test").alias("split"), iso(F.min("ts")).alias("capture_start_iso"), iso(F.max("ts")).alias("capture_end_iso"), listed.alias("labeled_events")).alias("c"))
    # a document for each capture, so that no task writes or reads them all
    by.select(F.col("capture_id").alias("part"), F.create_map("capture_id", "c").alias("captures")).write.partitionBy("part").json(folder)
    _, events, problems = T.read_manifest(spark, folder)
    told = events.join(problems, ["capture_id", "event_id"], "left")
    return told.select("capture_id", "event_order", "event_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "problem")


@query("ml_features", "SELECT seq, round(pps, 6) AS packets_per_sec, coalesce(periodicity, 0.0) AS periodicity_score, round(jitter, 6) AS jitter, CAST(coalesce(ja3 = 'J1', false) AS DOUBLE) AS j1, 0.0::DOUBLE AS duration, 52 AS width FROM ctx")
def ml_features(spark, d):
    c = V.contexts(spark, d).withColumn("ja3", F.when(F.col("ja3") == "J1", "a").otherwise(F.col("ja3")))
    f = M.to_ml_features(c)
    return f.select("seq", F.round("packets_per_sec", 6).alias("packets_per_sec"), "periodicity_score", F.round("jitter", 6).alias("jitter"), F.col("ja3_JA3_A").alias("j1"), "duration", F.lit(len(f.columns) - 1).alias("width"))


@query("map_labels", "SELECT event_order, list_position(['BENIGN', 'VOLUMETRIC_DDOS', 'BOTNET_C2_BEACONING', 'DGA_DNS_TUNNELLING', 'ENCRYPTED_MALWARE', 'RECON_PORT_SCAN', 'DATA_EXFILTRATION'], threat_class) - 1 AS label FROM gt")
def map_labels(spark, d):
    return M.map_labels(V.gt_events(spark, d), "threat_class").select("event_order", "label")


@query("column_group", "SELECT l_linenumber, sum(l_discount) AS l_discount, sum(l_tax) AS l_tax FROM (SELECT l_linenumber, round(l_discount * 100) AS l_discount, round(l_tax * 100) AS l_tax FROM lineitem) GROUP BY ALL", views=False)
def column_group(spark, d):
    li = R.column_group(V.read(spark, d, "lineitem"), ("l_line", "l_d", "l_t"), ("l_linestatus",))
    return li.groupBy("l_linenumber").agg(*(F.sum(F.round(F.col(c) * 100)).alias(c) for c in ("l_discount", "l_tax")))


@query("find_alert", SIG + "SELECT 'ALT-' || substr(sha256(concat_ws('|', entity, us, o)), 1, 8) AS alert_id, seq, o AS detector_order FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO' AND 'ALT-' || substr(sha256(concat_ws('|', entity, us, o)), 1, 8) = (SELECT min('ALT-' || substr(sha256(concat_ws('|', entity, us, o)), 1, 8)) FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO')")
def find_alert(spark, d):
    a = C.build_alerts(D.active_signals(signals(spark, d))).select("alert_id", "seq", "detector_order")
    return R.find(a, "alert_id", a.agg(F.min("alert_id")).first()[0])


@query("benign_only", "SELECT doc_id FROM labels WHERE toxic = 0", views=False)
def benign_only(spark, d):
    return R.benign_only(V.read(spark, d, "labels"), "toxic").select("doc_id")


@query("classification_metrics", CM + ", own AS (SELECT *, tp + fn AS support, coalesce(p, 0) AS p0, coalesce(r, 0) AS r0, coalesce(f1, 0) AS f0 FROM m3 WHERE tp + fn > 0 OR fp > 0) SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(p0), 6) AS macro_precision, round(avg(r0), 6) AS macro_recall, round(avg(f0), 6) AS macro_f1, round(sum(p0 * support) / sum(support), 6) AS weighted_precision, round(sum(r0 * support) / sum(support), 6) AS weighted_recall, round(sum(f0 * support) / sum(support), 6) AS weighted_f1 FROM own")
def classification_metrics(spark, d):
    return rounded(E.classification_metrics(V.decisions(spark, d), "truth", "predicted"))


METRICS = "mt AS (SELECT CASE WHEN decision_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, avg(CAST(truth = predicted AS INTEGER)) AS accuracy, avg(CAST(predicted = 'BENIGN' AS INTEGER)) AS macro_f1 FROM decisions GROUP BY ALL), lm AS (UNPIVOT mt ON accuracy, macro_f1 INTO NAME metric VALUE value)"


def metric_rows(spark, d):
    n = V.decisions(spark, d).withColumn("split", F.when(F.col("decision_id") % 2 == 0, "train").otherwise("val"))
    wide = n.groupBy("split").agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"), F.avg((F.col("predicted") == "BENIGN").cast("int")).alias("macro_f1"))
    return E.long_metrics(wide, ("split",))


@query("train_val_gap", f"WITH {METRICS}, g AS (SELECT metric, max(value) FILTER (split = 'train') - max(value) FILTER (split = 'val') AS gap FROM lm GROUP BY ALL) SELECT metric, round(gap, 6) AS gap, metric = 'macro_f1' AND gap > 0.001 AS overfit FROM g")
def train_val_gap(spark, d):
    return rounded(R.train_val_gap(metric_rows(spark, d), 0.001))


@query("fold_summary", f"WITH {METRICS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM lm GROUP BY ALL")
def fold_summary(spark, d):
    return rounded(E.fold_summary(metric_rows(spark, d)))


@query("top_features", "SELECT l_suppkey AS feature, round(sum(l_quantity), 2) AS gain FROM lineitem GROUP BY ALL ORDER BY gain DESC, feature LIMIT 20", views=False)
def top_features(spark, d):
    return R.top_features(V.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(F.round(F.sum("l_quantity"), 2).alias("gain")))


@query("scalars", """SELECT seq, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, us AS again_us, us / 1e6 AS seconds, us // 3600000000 AS bucket, CASE WHEN value < 50 OR k % 7 >= 5 THEN 0.0 ELSE value - 50 END AS excess,
  round(1 / (1 + exp(CASE WHEN value < 50 THEN 1.0 ELSE -1.0 END * (value / 100 - 0.5) * 20)), 4) AS confidence, CASE WHEN k % 2 = 0 THEN 'DOMAIN' ELSE 'EXTERNAL_IP' END AS node, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS evidence FROM base""")
def scalars(spark, d):
    b = V.base(spark, d)
    us_ = F.unix_micros("ts")
    target = F.when(F.col("k") % 2 == 0, F.concat(F.lit("h"), F.col("k").cast("string"), F.lit(".example"))).otherwise(F.col("host"))
    excess = F.when(F.col("k") % 7 == 5, float("nan")).when(F.col("k") % 7 == 6, float("inf")).otherwise(F.col("value") - 50)
    indicators = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)))
    return b.select("seq", S.epoch_to_iso(us_).alias("iso"), F.unix_micros(S.iso_to_ts(S.epoch_to_iso(us_))).alias("again_us"), S.epoch_seconds("ts").alias("seconds"), S.bucket_id("ts", 3600.0).alias("bucket"), S.non_negative_finite(excess).alias("excess"),
                    S.anomaly_confidence(F.col("value") / 100 - 0.5, F.col("value") < 50).alias("confidence"), S.node_type(target).alias("node"), S.evidence_count(indicators).alias("evidence"))


@query("alert_summaries", SIG + """, c AS (SELECT sig.seq, o, threat_class, sig.entity, sig.target, ctx.pps, ctx.syn_ratio, ctx.periodicity, ctx.jitter, sig.seq % 50 / 10 AS entropy_mean FROM sig JOIN ctx USING (seq))
SELECT seq, o AS detector_order, CASE o WHEN 0 THEN 'Volumetric Ddos' WHEN 1 THEN 'Botnet C2 Beaconing' ELSE 'Encrypted Malware' END || ' activity detected from ' || entity || ' toward ' || CASE WHEN seq % 3 = 0 THEN 'external infrastructure' ELSE target END || ' (' || format('{:.1f} pps', round(pps, 1))
  || coalesce(format(', SYN ratio {:.2f}', round(syn_ratio, 2)), '') || coalesce(format(', periodicity {:.2f}', round(periodicity, 2)), '') || format(', jitter {:.1f}%', round(jitter, 1)) || format(', DNS entropy {:.2f}', round(entropy_mean, 2)) || ').' AS summary FROM c""")
def alert_summaries(spark, d):
    told = ("pps", "syn_ratio", "periodicity", "jitter")
    s = D.run_detectors(V.contexts(spark, d), ["ddos", "c2", "encrypted"], keep=("seq", "entity", "target", *told))
    s = s.withColumns({"target": F.when(F.col("seq") % 3 != 0, F.col("target")), "entropy_mean": F.col("seq") % 50 / 10})
    return s.select("seq", "detector_order", C.alert_summary(s.columns).alias("summary"))


@query("incident_alerts", INC + f"SELECT seq, o AS detector_order, 'Correlated Incident ' || incident_id || ': ' || threat_class || ' on ' || entity || ' (Risk: ' || {_fixed('risk', 2)} || ', Stages: ' || signals || ')' AS summary FROM grp JOIN inci USING (entity, group_no)")
def incident_alerts(spark, d):
    g = grouped_once(spark, d)
    return C.build_alerts(g, incidents_of(g)).select("seq", "detector_order", "summary")


@query("provenance", SIG + """SELECT sig.seq, o AS detector_order, CASE o WHEN 0 THEN 'ddos' WHEN 1 THEN 'c2' ELSE 'encrypted' END AS detector_id, '1.0.0' AS detector_version, sig.us AS start_us, sig.us + 5000000 AS end_us, ctx.pps, ctx.syn_ratio,
  CASE o WHEN 0 THEN concat_ws(',', CASE WHEN ctx.pps > 5000 THEN 'critical_packet_velocity_exceeded' WHEN ctx.pps > 1000 THEN 'suspicious_packet_velocity_observed' END, CASE WHEN syn_ratio > 0.8 THEN 'critical_tcp_syn_flood_ratio' WHEN syn_ratio > 0.5 THEN 'elevated_tcp_syn_ratio' END)
  WHEN 1 THEN concat_ws(',', CASE WHEN periodicity >= 0.8 THEN 'high_temporal_periodicity_observed' END, CASE WHEN jitter <= 15 THEN 'low_inter_arrival_jitter_beacon' END, CASE WHEN periodicity IS NOT NULL AND jitter IS NOT NULL AND observations < 5 THEN 'insufficient_observations_penalty_applied' END)
  ELSE concat_ws(',', CASE WHEN ja3 <> '' THEN 'suspicious_ja3_fingerprint_match' END, CASE WHEN (ja3 <> '' OR sni <> '' OR alpn <> '') AND periodicity IS NOT NULL THEN 'correlated_temporal_periodicity_observed' END) END AS reasons FROM sig JOIN ctx USING (seq)""")
def provenance(spark, d):
    s = D.run_detectors(V.contexts(spark, d), ["ddos", "c2", "encrypted"], keep=("seq", "ts", "pps", "syn_ratio")).withColumns({"window_start": F.col("ts"), "window_end": F.col("ts") + F.expr("INTERVAL 5 SECONDS")})
    told = s.select("seq", "detector_order", R.provenance(observed=("pps", "syn_ratio")).alias("p"))
    return told.select("seq", "detector_order", "p.detector_id", "p.detector_version", us("p.window_start", "start_us"), us("p.window_end", "end_us"), "p.observed_features.pps", "p.observed_features.syn_ratio", F.array_join("p.decision_reason", ",").alias("reasons"))


@query("export_graph", EDGE + """, nd AS (SELECT DISTINCT entity AS id, 'HOST_IP' AS type FROM act UNION SELECT sid, 'SIGNAL' FROM act UNION SELECT target, 'EXTERNAL_IP' FROM act)
SELECT 'node' AS kind, '{"id":"' || id || '","type":"' || type || '"}' AS json FROM nd UNION ALL SELECT DISTINCT 'link', '{"source":"' || src || '","target":"' || dst || '","type":"' || type || '"}' FROM ed""")
def export_graph(spark, d):
    s = D.active_signals(signals(spark, d))
    return G.export_graph(G.signal_nodes(s), G.distinct_edges(edges_of(spark, d)))


@query("alerts_json", SIG + "SELECT 'ALT-' || substr(sha256(concat_ws('|', entity, us, o)), 1, 8) AS alert_id, entity, threat_class, severity, round(confidence, 9) AS confidence FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO'")
def alerts_json(spark, d):
    """Alerts written as JSON lines in the shared folder and read back by their schema."""
    path = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    a = C.build_alerts(D.active_signals(signals(spark, d))).withColumn("incident_id", F.lit(None).cast("string"))
    T.write_alerts(a.select(*(x.split()[0] for x in SCHEMAS["alerts"].split(", "))), path)
    return T.alerts_from_json(spark.read.text(path)).select("alert_id", "entity", "threat_class", "severity", F.round("confidence", 9).alias("confidence"))


@query("export_splits", f"WITH {ITEMS} SELECT split, count(*) AS rows, 'l_orderkey,l_linenumber,l_quantity' AS columns FROM li GROUP BY ALL", views=False)
def export_splits(spark, d):
    """Rows written by split, and the manifest read back."""
    path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    T.export_splits(items(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "split"), path)
    written = spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.schema("split string, rows long, columns string").json(f"{path}/manifest").join(written, "split").where("rows = n").drop("n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows to reconnaissance signals of each internal host, the most confident first."""
    f = V.flows(spark, sf_dir)
    s = D.detect(X.recon_features(f, ["src_ip"], 30 * DAY), "recon")
    return D.active_signals(s.where(F.col("src_ip").startswith("10."))).select("src_ip", "flow_count", "unique_dst_ips", "unique_dst_ports", "scan_type", "confidence", "severity").orderBy(F.desc("confidence"), "src_ip")


#: The host ``10.0.n.m`` as four bytes: what n holds above 255 is carried on.
CARRIED = "((10 + n // 65536) % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) || '.' || split_part(src_ip, '.', 4)"
CAPTURED = f"SELECT us, {CARRIED} AS src_ip, src_port, dst_ip, dst_port, protocol, packet_length, tcp_syn, tcp_ack, tcp_rst FROM (SELECT us, src_ip, src_port, dst_ip, dst_port, protocol, packet_length, CASE WHEN protocol = 6 THEN tcp_syn ELSE 0 END AS tcp_syn, CASE WHEN protocol = 6 THEN tcp_ack ELSE 0 END AS tcp_ack, CASE WHEN protocol = 6 THEN tcp_rst ELSE 0 END AS tcp_rst, CAST(split_part(src_ip, '.', 3) AS BIGINT) AS n FROM packets)"


def captured(spark, d) -> str:
    """The packets of the events as captures, in a new shared folder.

    A host is ``10.0.n.m`` of its user's number, and n passes 255 where there
    are more than 65,536 users; a frame holds four bytes, so n is carried on.
    """
    path = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    n = F.split_part("src_ip", F.lit("."), F.lit(3)).cast("long")
    whole = F.concat_ws(".", (10 + F.floor(n / 65536)) % 256, F.floor(n / 256) % 256, n % 256, F.split_part("src_ip", F.lit("."), F.lit(4)))
    K.write_captures(K.encode_frames(V.packets(spark, d).withColumn("src_ip", whole)), path)
    return path


def told(packets: DataFrame) -> DataFrame:
    return packets.select(us("ts"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packet_length", "tcp_syn", "tcp_ack", "tcp_rst")


@query("capture_ranges", CAPTURED)
def capture_ranges(spark, d):
    return told(P.decode_frames(K.numbered(K.read_capture_ranges(spark, captured(spark, d), 1 << 20))))


@query("capture_stats", "SELECT count(*) AS seen, CAST(0 AS BIGINT) AS too_large, count(*) AS yielded, CAST(0 AS BIGINT) AS rejected FROM packets")
def capture_stats(spark, d):
    path = captured(spark, d)
    packets, stats = P.observed_packets(K.read_capture_ranges(spark, path, 1 << 20))
    packets.write.parquet(f"{path}-packets")
    found = stats()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))
