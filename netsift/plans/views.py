"""The derived traffic views over the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship_package

# Destination port by event type.
PORTS = {"click": 80, "view": 443, "signup": 22, "purchase": 8443, "error": 53}
CLASSES = ("RECON_PORT_SCAN", "DGA_DNS_TUNNELLING", "BOTNET_C2_BEACONING", "ENCRYPTED_MALWARE", "DATA_EXFILTRATION", "VOLUMETRIC_DDOS")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    user = F.col("user_id")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (user % 256).cast("string")).alias("host"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t = base(spark, sf_dir), F.col("event_type")
    port = F.element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), t)
    flag = lambda c: c.cast("long")
    return b.select(
        "seq", "ts", F.col("host").alias("src_ip"), F.lit(40000).alias("src_port"), F.concat(F.lit("198.51.100."), (F.col("k") % 4).cast("string")).alias("dst_ip"), port.alias("dst_port"),
        F.when(t == "error", 17).otherwise(6).alias("protocol"), (40 + F.floor("value") % 1460).cast("long").alias("packet_length"),
        flag(t == "signup").alias("tcp_syn"), flag(t.isin("click", "view", "purchase")).alias("tcp_ack"), F.lit(0).cast("long").alias("tcp_fin"), flag(F.col("k") % 10 == 0).alias("tcp_rst"), F.lit(0).cast("long").alias("tcp_psh"), F.lit(0).cast("long").alias("tcp_urg"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, inbound = base(spark, sf_dir), F.col("event_type") == "view"
    peer = F.concat(F.lit("198.51.100."), F.col("k").cast("string"))
    return b.select(
        "seq", "ts", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.when(inbound, peer).otherwise(F.col("host")).alias("src_ip"), F.lit(40000).alias("src_port"),
        F.when(inbound, F.col("host")).otherwise(peer).alias("dst_ip"), (1000 + F.col("k")).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(1).cast("long").alias("packet_count"),
        F.floor(F.col("value") * 20000).cast("long").alias("byte_count"), (F.col("event_type") == "error").cast("long").alias("rst_count"), F.lit(0).cast("long").alias("syn_count"), F.lit(1).cast("long").alias("ack_count"),
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = base(spark, sf_dir), F.col("k")
    return b.select(
        "seq", "ts", F.col("host").alias("entity"), (F.col("value") * 20).alias("pps"), F.when(k % 7 != 0, k / 100).alias("syn_ratio"), F.when(k % 11 != 0, k / 100).alias("periodicity"), (F.col("value") / 5).alias("jitter"),
        (F.col("seq") % 10).alias("observations"), F.when(k % 2 == 0, F.concat(F.lit("J"), (k % 5).cast("string"))).alias("ja3"), F.lit(None).cast("string").alias("ja4"),
        F.when(k % 3 != 0, F.lit("s.example")).alias("sni"), F.when(k % 4 != 0, F.lit("h2")).alias("alpn"), F.concat(F.lit("198.51.100."), (k % 4).cast("string")).alias("target"),
    )


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    n = F.col("page_id")
    return p.select((n % 20).alias("key"), n.alias("seq"), F.regexp_extract("url", r"//([^/?#]*)", 1).alias("query"), F.when(n % 5 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"), F.when(n % 4 == 0, "TXT").otherwise("A").alias("qtype"))


def gt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).where("event_type = 'error'")
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("k") % 6 + 1)
    return b.select(F.col("host").alias("entity"), name.alias("threat_class"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"), F.col("seq").alias("event_order"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    name = lambda c: F.when(c == 1, "THREAT").otherwise("BENIGN")
    return read(spark, sf_dir, "labels").select(n.alias("decision_id"), name(F.col("toxic")).alias("truth"), name(1 - F.col("quality")).alias("predicted"), (n % 97).cast("double").alias("latency"))


#: The same views as common table expressions.
SQL = r"""
base AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS us, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS host FROM events
),
packets AS (
  SELECT seq, us, host AS src_ip, 40000 AS src_port, '198.51.100.' || (k % 4) AS dst_ip,
         CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 22 WHEN 'purchase' THEN 8443 ELSE 53 END AS dst_port,
         CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS protocol, 40 + CAST(floor(value) AS BIGINT) % 1460 AS packet_length,
         CAST(event_type = 'signup' AS BIGINT) AS tcp_syn, CAST(event_type IN ('click', 'view', 'purchase') AS BIGINT) AS tcp_ack, CAST(k % 10 = 0 AS BIGINT) AS tcp_rst FROM base
),
flows AS (
  SELECT seq, us, CASE WHEN event_type = 'view' THEN '198.51.100.' || k ELSE host END AS src_ip, CASE WHEN event_type = 'view' THEN host ELSE '198.51.100.' || k END AS dst_ip,
         1000 + k AS dst_port, CAST(floor(value * 20000) AS BIGINT) AS byte_count, CAST(event_type = 'error' AS BIGINT) AS rst_count FROM base
),
ctx AS (
  SELECT seq, us, host AS entity, value * 20 AS pps, CASE WHEN k % 7 <> 0 THEN k / 100 END AS syn_ratio, CASE WHEN k % 11 <> 0 THEN k / 100 END AS periodicity, value / 5 AS jitter,
         seq % 10 AS observations, CASE WHEN k % 2 = 0 THEN 'J' || (k % 5) END AS ja3, CAST(NULL AS VARCHAR) AS ja4, CASE WHEN k % 3 <> 0 THEN 's.example' END AS sni, CASE WHEN k % 4 <> 0 THEN 'h2' END AS alpn,
         '198.51.100.' || (k % 4) AS target FROM base
),
dns AS (
  SELECT page_id % 20 AS key, page_id AS seq, regexp_extract(url, '//([^/?#]*)', 1) AS query, CASE WHEN page_id % 5 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode, CASE WHEN page_id % 4 = 0 THEN 'TXT' ELSE 'A' END AS qtype FROM pages
),
gt AS (
  SELECT host AS entity, ['RECON_PORT_SCAN', 'DGA_DNS_TUNNELLING', 'BOTNET_C2_BEACONING', 'ENCRYPTED_MALWARE', 'DATA_EXFILTRATION', 'VOLUMETRIC_DDOS'][k % 6 + 1] AS threat_class,
         us AS lo, us + 7200000000 AS hi, seq AS event_order FROM base WHERE event_type = 'error'
),
decisions AS (
  SELECT doc_id AS decision_id, CASE WHEN toxic = 1 THEN 'THREAT' ELSE 'BENIGN' END AS truth, CASE WHEN quality = 0 THEN 'THREAT' ELSE 'BENIGN' END AS predicted, CAST(doc_id % 97 AS DOUBLE) AS latency FROM labels
)"""
