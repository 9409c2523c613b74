"""The streaming operators over the events table, run until all that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir, ship_package
from ..operators import detectors as D
from ..operators import flows as L
from ..sources import capture_source as K
from ..sources import captures as P
from ..streaming import streams as T
from . import views as V
from .queries import CAPTURED, DAY, KEY, SESSIONS, SIG, H, captured, query, told, us


class _Streamed:
    """Stands for a session whose tables are read as streams, so that the views serve both."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sparkContext = spark.sparkContext
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        # the last letter as a pattern: a stream reads folders or patterns, the table may be one file
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream emits for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


CLOSED = "(SELECT max(us) // 1000 * 1000 - 30000000 FROM packets)"


@query("stream_flows", SESSIONS + f"SELECT src_ip, dst_ip, dst_port, protocol, start_us, end_us, packet_count, byte_count FROM f WHERE end_us + 43200000000 <= {CLOSED}")
def stream_flows(spark, d):
    return drained(T.stream_flows(V.packets(_Streamed(spark), d), "12 hours")).select(*KEY, us("start_ts"), us("end_ts"), "packet_count", "byte_count")


@query("stream_window", f"WITH w AS (SELECT src_ip, us // 21600000000 * 21600000000 AS start_us, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets GROUP BY ALL) SELECT * FROM w WHERE start_us + 21600000000 <= {CLOSED}")
def stream_window(spark, d):
    return drained(T.stream_window(V.packets(_Streamed(spark), d), "6 hours")).select("src_ip", us("start", "start_us"), "packets", "bytes")


@query("stream_hopping", f"WITH h AS (SELECT src_ip, us // 10800000000 * 10800000000 - shift AS start_us, packet_length FROM packets, (SELECT unnest([0, 10800000000]) AS shift)), w AS (SELECT src_ip, start_us, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM h GROUP BY ALL) SELECT * FROM w WHERE start_us + 21600000000 <= {CLOSED}")
def stream_hopping(spark, d):
    return drained(T.stream_window(V.packets(_Streamed(spark), d), "6 hours", "3 hours")).select("src_ip", us("start", "start_us"), "packets", "bytes")


@query("stream_correlate", SIG + f""", g AS (SELECT entity, us, sum(CASE WHEN us - prev > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, lag(us) OVER (PARTITION BY entity ORDER BY us, o) AS prev FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO')),
h AS (SELECT entity, n, count(*) AS signals, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY ALL) SELECT entity, signals, first_us, last_us FROM h WHERE last_us + 86400000000 <= (SELECT max(us) // 1000 * 1000 - 300000000 FROM sig WHERE confidence >= 0.1 AND severity <> 'INFO')""")
def stream_correlate(spark, d):
    s = D.active_signals(D.run_detectors(V.contexts(_Streamed(spark), d), ["ddos", "c2", "encrypted"]))
    return drained(T.stream_correlate(s, "1 day")).select("entity", "signals", us("first_ts"), us("last_ts"))


@query("stream_trailing", """
WITH n AS (SELECT seq, us, src_ip, packet_length, tcp_syn, tcp_ack, max(us) OVER (PARTITION BY src_ip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS end_us FROM packets)
SELECT a.src_ip, a.seq, a.end_us, count(*) AS packets, CAST(sum(b.packet_length) AS BIGINT) AS bytes, CAST(sum(b.tcp_syn) AS BIGINT) AS syn, CAST(sum(b.tcp_ack) AS BIGINT) AS ack, count(*) / 21600.0::DOUBLE AS rate
FROM n a JOIN n b ON a.src_ip = b.src_ip AND b.seq <= a.seq AND b.us >= a.end_us - 21600000000 GROUP BY ALL""")
def stream_trailing(spark, d):
    out = drained(T.stream_trailing(V.packets(_Streamed(spark), d), 6 * H, ttl_seconds=60 * DAY))
    return out.select("src_ip", "seq", us("end_ts"), "packets", "bytes", "syn", "ack", "rate")


@query("stream_throttle", """
WITH n AS (SELECT seq, us, src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY us, seq) AS no FROM packets),
k AS (
  SELECT src_ip, no, seq, us AS last, true AS kept FROM n WHERE no = 1
  UNION ALL
  SELECT n.src_ip, n.no, n.seq, CASE WHEN n.us - k.last >= 43200000000 THEN n.us ELSE k.last END, n.us - k.last >= 43200000000 FROM k JOIN n ON n.src_ip = k.src_ip AND n.no = k.no + 1
) SELECT src_ip, seq FROM k WHERE kept""")
def stream_throttle(spark, d):
    return drained(T.stream_throttle(V.packets(_Streamed(spark), d), "src_ip", 12 * H, 60 * DAY)).select("src_ip", "seq")


@query("stream_first_crossing", "WITH n AS (SELECT *, row_number() OVER w AS no, sum(packet_length) OVER w AS bytes FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY us, seq ROWS UNBOUNDED PRECEDING)) SELECT src_ip, dst_ip, dst_port, us, no AS packet_count, CAST(bytes AS BIGINT) AS byte_count FROM n WHERE no = 3")
def stream_first_crossing(spark, d):
    return drained(T.stream_first_crossing(V.packets(_Streamed(spark), d), 3, 60 * DAY)).select("src_ip", "dst_ip", "dst_port", us("ts"), "packet_count", "byte_count")


@query("stream_entity_context", """
WITH e AS (SELECT seq, us, src_ip AS entity, true AS outbound, dst_ip, byte_count FROM flows UNION ALL SELECT seq, us, dst_ip, false, dst_ip, byte_count FROM flows)
SELECT seq, entity, CAST(sum(CAST(outbound AS INTEGER)) OVER w AS BIGINT) AS flows_out, CAST(sum(CASE WHEN outbound THEN byte_count ELSE 0 END) OVER w AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN outbound THEN 0 ELSE byte_count END) OVER w AS BIGINT) AS bytes_in,
       CAST(len(list_distinct(list(CASE WHEN outbound THEN dst_ip END) OVER w)) AS BIGINT) AS distinct_dst_ips
FROM e WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""")
def stream_entity_context(spark, d):
    e = L.explode_entities(V.flows(_Streamed(spark), d))
    return drained(T.stream_entity_context(e, 7 * DAY, 60 * DAY)).select("seq", "entity", "flows_out", "bytes_out", "bytes_in", "distinct_dst_ips")


@query("stream_captures", CAPTURED)
def stream_captures(spark, d):
    return told(drained(P.decode_frames(K.stream_captures(spark, captured(spark, d), 1 << 20))))
