"""Per-entity features: temporal, DNS, TLS, reconnaissance, exfiltration, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_subdomain, jitter_pct, nonempty, periodicity_cv, periodicity_linear, scan_type, shannon_entropy
from .flows import FIVE, explode_entities, failed_connection, sessions


def temporal_features(events: DataFrame, key: list[str], min_obs: int = 2, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Mean and sample deviation of inter-arrival times (ms), jitter and periodicity; null under ``min_obs`` events."""
    order = Window.partitionBy(*key).orderBy(ts, tie)
    gaps = events.withColumn("__gap", (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(order)) / 1000)
    sums = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("observations"), F.avg("__gap").alias("mean"), F.coalesce(F.stddev_samp("__gap"), F.lit(0.0)).alias("std"))
    enough = F.col("observations") >= min_obs
    return sums.select(
        *key, "observations", F.when(enough, F.col("mean")).alias("inter_arrival_mean_ms"), F.when(enough, F.col("std")).alias("inter_arrival_std_ms"),
        F.when(enough, jitter_pct("mean", "std")).alias("jitter_pct"), F.when(enough, periodicity_cv("mean", "std")).alias("periodicity_score"),
    )


def packet_periodicity(events: DataFrame, key: list[str], min_iats: int = 3, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The evaluation's periodicity: population deviation, and a score that is 0 from 50 per cent jitter."""
    order = Window.partitionBy(*key).orderBy(ts, tie)
    gaps = events.withColumn("__gap", (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(order)) / 1000)
    sums = gaps.groupBy(*key).agg(F.count("__gap").alias("iats"), F.avg("__gap").alias("mean"), F.stddev_pop("__gap").alias("std")).where(F.col("iats") >= min_iats)
    return sums.withColumn("jitter_pct", jitter_pct("mean", "std")).withColumn("periodicity_score", periodicity_linear("jitter_pct"))


def temporal_features_of_last_flow(flows: DataFrame, key: list[str], columns: list[str], min_obs: int = 2) -> DataFrame:
    """The last flow's columns with the temporal features over all flows of the key."""
    last = flows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("__last")).select(*key, *(F.col(f"__last.{c}").alias(c) for c in columns))
    return temporal_features(flows, key, min_obs).join(last, key)


def dns_features(records: DataFrame, key: list[str]) -> DataFrame:
    """Mean length and entropy of queries that are not empty, NXDOMAIN count, TXT share, queries with subdomains."""
    q = nonempty("query")
    return records.withColumn("__q", q).groupBy(*key).agg(
        F.avg(F.length("__q")).alias("query_length_mean"), F.avg(F.when(F.col("__q").isNotNull(), shannon_entropy("__q"))).alias("entropy_mean"),
        F.count_if(F.upper("rcode") == "NXDOMAIN").alias("nxdomain_count"), F.avg((F.upper("qtype") == "TXT").cast("double")).alias("txt_record_ratio"),
        F.count_if(has_subdomain("__q")).alias("subdomain_count"),
    )


def tls_features(records: DataFrame, key: list[str], order: str = "seq", fields: tuple[str, ...] = ("ja3", "ja4", "sni", "alpn")) -> DataFrame:
    """The first non-empty value of each field, each for itself."""
    return records.groupBy(*key).agg(*(F.min_by(nonempty(f), F.when(nonempty(f).isNotNull(), F.col(order))).alias(f) for f in fields if f in records.columns))


def recon_features(flows: DataFrame, key: list[str] = ("src_ip",), window_sec: float = 60.0, ip_threshold: int = 5, port_threshold: int = 5, min_flows: int = 3, rule: str = "reset") -> DataFrame:
    """Fan-out, failures, rate and scan type of an entity's flows."""
    out = flows.groupBy(*key).agg(F.count(F.lit(1)).alias("flow_count"), F.count_distinct("dst_ip").alias("unique_dst_ips"), F.count_distinct("dst_port").alias("unique_dst_ports"), F.count_if(failed_connection(rule)).alias("failed_count"))
    return out.withColumns({"failed_ratio": F.col("failed_count") / F.col("flow_count"), "connection_rate": F.col("flow_count") / F.lit(float(window_sec)), "scan_type": scan_type("unique_dst_ips", "unique_dst_ports", ip_threshold, port_threshold), "sufficient": F.col("flow_count") >= min_flows})


def exfil_features(flows: DataFrame, window_sec: float | None = None, large: float = 1e6, min_flows: int = 3) -> DataFrame:
    """In and out volumes of every entity in one shuffle; ratios are null where their base is 0.

    Without ``window_sec`` the window is the span of the entity's own flows
    (60 seconds where that is nothing).
    """
    e = explode_entities(flows)
    out, zero = F.col("outbound"), F.lit(0)
    span = (F.unix_micros(F.max("end_ts")) - F.unix_micros(F.min("start_ts"))) / 1e6
    window = F.lit(float(window_sec)) if window_sec else F.when(span > 0, span).otherwise(60.0)
    sums = e.groupBy("entity").agg(
        F.count(F.lit(1)).alias("flow_count"), F.count_if(out).alias("outbound_flows"), F.count_if(~out).alias("inbound_flows"),
        F.sum(F.when(out, F.col("byte_count")).otherwise(zero)).alias("outbound_bytes"), F.sum(F.when(out, zero).otherwise(F.col("byte_count"))).alias("inbound_bytes"),
        F.max("byte_count").alias("max_flow_bytes"), F.count_if(F.col("byte_count") >= large).alias("large_transfers"),
        F.count_distinct(F.when(out, F.col("dst_ip"))).alias("destinations"), window.alias("window_sec"),
    )
    return sums.withColumns(
        {
            "outbound_share": F.try_divide("outbound_bytes", F.col("outbound_bytes") + F.col("inbound_bytes")),
            "up_down_ratio": F.when(F.col("inbound_bytes") > 0, F.col("outbound_bytes") / F.col("inbound_bytes")),
            "outbound_rate": F.col("outbound_bytes") / F.col("window_sec"),
            "sufficient": F.col("flow_count") >= min_flows,
            "direction_available": F.lit(True),
        }
    )


def batch_entity_features(flows: DataFrame, window_start, window_end) -> DataFrame:
    """Reconnaissance and exfiltration features of every entity in [start, end); an empty window is an error."""
    if window_end <= window_start:
        raise ValueError("the window must end after it starts")
    inside = flows.where((F.col("start_ts") >= F.lit(window_start)) & (F.col("start_ts") < F.lit(window_end)))
    seconds = (window_end - window_start).total_seconds()
    recon = recon_features(inside, ["src_ip"], seconds).withColumnRenamed("src_ip", "entity").drop("flow_count", "sufficient")
    return exfil_features(inside, seconds).join(recon, "entity", "left")


def in_out_volumes(flows: DataFrame) -> DataFrame:
    e = explode_entities(flows)
    return e.groupBy("entity").agg(F.sum(F.when(F.col("outbound"), F.col("byte_count")).otherwise(0)).alias("out_bytes"), F.sum(F.when(~F.col("outbound"), F.col("byte_count")).otherwise(0)).alias("in_bytes"))


def entity_profiles(contexts: DataFrame, signals: DataFrame | None = None, max_signals: int = 100) -> DataFrame:
    """First and last sight, observations and how many destinations, ports, fingerprints and, of at most ``max_signals``, active signals each entity has."""
    known = {"known_destinations": "dst_ip", "known_ports": "dst_port", "known_ja3": "ja3", "known_ja4": "ja4", "known_domains": "sni"}
    counts = [F.count_distinct(c).alias(n) for n, c in known.items() if c in contexts.columns]
    found = contexts.groupBy("entity").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("observations"), *counts)
    if signals is None:
        return found
    active = signals.groupBy("entity").agg(F.least(F.count(F.lit(1)), F.lit(max_signals)).alias("active_signals"))
    return found.join(active, "entity", "left").withColumn("active_signals", F.coalesce("active_signals", F.lit(0)))


def sample_known_destinations(flows: DataFrame, k: int = 5, entity: str = "src_ip") -> DataFrame:
    """The first ``k`` destinations of each entity in text order, by rank rather than by gathering all."""
    w = Window.partitionBy(entity).orderBy("dst_ip")
    ranked = flows.select(entity, "dst_ip").distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    return ranked.groupBy(entity).agg(F.array_sort(F.collect_list("dst_ip")).alias("sample"))


def most_recent_entities(profiles: DataFrame, n: int = 50_000, ttl_seconds: float = 900.0) -> DataFrame:
    """The ``n`` entities seen last, none idle for longer than ``ttl_seconds`` before the newest."""
    newest = profiles.agg(F.max("last_seen").alias("__newest"))
    fresh = profiles.join(F.broadcast(newest)).where(F.unix_micros("last_seen") >= F.unix_micros("__newest") - int(ttl_seconds * 1e6))
    return fresh.drop("__newest").orderBy(F.desc("last_seen"), "entity").limit(n)


def new_destinations(pairs: DataFrame, known: DataFrame, on: tuple[str, ...] = ("entity", "dst_ip")) -> DataFrame:
    return pairs.select(*on).distinct().join(known, list(on), "left_anti")


def asof_baseline(signals: DataFrame, profiles: DataFrame, value: str, key: str = "entity") -> DataFrame:
    """Each signal with the latest profile value at or before its time, by one sort and no join."""
    right = profiles.select(key, "ts", F.col(value).alias("__v"), F.lit(0).alias("__side"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in signals.schema if f.name not in (key, "ts")))
    left = signals.select(key, "ts", F.lit(None).cast(profiles.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"), *(c for c in signals.columns if c not in (key, "ts")))
    w = Window.partitionBy(key).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__v", "__side")


def capped_cardinality(df: DataFrame, key: list[str], value: str, cap: int = 1000) -> DataFrame:
    """Exact distinct values per group, and whether they exceed the cap."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n")).select(*key, F.least("n", F.lit(cap)).alias("cardinality"), (F.col("n") > cap).alias("capped"))


def context_join(base: DataFrame, *features: DataFrame, on: tuple[str, ...] = ("entity",)) -> DataFrame:
    """One wide context row per key; features that are missing stay null."""
    for f in features:
        base = base.join(f, list(on), "left")
    return base


def packet_contexts(packets: DataFrame, gap_seconds: float = 30.0, rule: str = "reset") -> DataFrame:
    """At each packet, the state of its flow and of its source by then: what the detectors read.

    Of the flow: rates, flag share, and, from three inter-arrival times on,
    jitter and periodicity. Of the source: flows begun, distinct destinations
    and ports, failed flows, bytes out and in. Distinct counts are running
    sums of first sights and failures running sums of changes, so no frame
    holds more than numbers. Packets are dealt by source once, for all windows
    over flows and first sights, and by entity once more.
    """
    flow = Window.partitionBy(*FIVE, "session").orderBy("ts", "seq")
    so_far = flow.rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros("ts")
    p = sessions(packets.repartition("src_ip"), gap_seconds).withColumns(
        {
            "observations": F.count(F.lit(1)).over(so_far), "byte_count": F.sum("packet_length").over(so_far), "syn_count": F.sum("tcp_syn").over(so_far), "ack_count": F.sum("tcp_ack").over(so_far),
            "rst_count": F.sum("tcp_rst").over(so_far), "start_us": F.min(us).over(so_far), "iat": (us - F.lag(us).over(flow)) / 1000,
        }
    )
    p = p.withColumns({"iats": F.count("iat").over(so_far), "mean": F.avg("iat").over(so_far), "std": F.stddev_pop("iat").over(so_far), "failed_now": failed_connection(rule).cast("int")})
    p = p.withColumn("failed_change", F.col("failed_now") - F.coalesce(F.lag("failed_now").over(flow), F.lit(0)))
    first = lambda *key: (F.row_number().over(Window.partitionBy("src_ip", *key).orderBy("ts", "seq")) == 1).cast("long")
    p = p.withColumns({"new_ip": first("dst_ip"), "new_port": first("dst_port"), "new_flow": (F.col("observations") == 1).cast("long")})
    own = Window.partitionBy("entity").orderBy("ts", "seq", F.desc("outbound")).rowsBetween(Window.unboundedPreceding, 0)
    out = F.col("outbound")
    total = lambda c, when=out: F.sum(F.when(when, F.col(c)).otherwise(0)).over(own)
    e = explode_entities(p).withColumns(
        {
            "flow_count": total("new_flow"), "unique_dst_ips": total("new_ip"), "unique_dst_ports": total("new_port"), "failed_count": total("failed_change"),
            "outbound_bytes": total("packet_length"), "inbound_bytes": total("packet_length", ~out), "first_us": F.min(F.when(out, us)).over(own),
        }
    ).where("outbound")
    seconds, life = (us - F.col("start_us")) / 1e6, F.greatest(F.lit(1.0), (us - F.col("first_us")) / 1e6)
    zero, timed = F.lit(0.0), F.col("iats") >= 3
    jitter = jitter_pct("mean", "std")
    return e.select(
        "seq", "ts", "entity", F.col("dst_ip").alias("target"), "observations",
        F.coalesce(F.try_divide("observations", seconds), zero).alias("pps"), F.coalesce(F.try_divide("byte_count", seconds), zero).alias("bytes_per_sec"), (F.col("syn_count") / F.col("observations")).alias("syn_ratio"),
        F.when(timed, jitter).alias("jitter"), F.when(timed, periodicity_linear(jitter)).alias("periodicity"),
        "flow_count", "unique_dst_ips", "unique_dst_ports", (F.col("failed_count") / F.col("flow_count")).alias("failed_ratio"), (F.col("flow_count") / life).alias("connection_rate"), (F.col("flow_count") >= 3).alias("sufficient"),
        "outbound_bytes", (F.col("outbound_bytes") / life).alias("outbound_rate"), F.when(F.col("inbound_bytes") > 0, F.col("outbound_bytes") / F.greatest(F.lit(1.0), F.col("inbound_bytes"))).when(F.col("outbound_bytes") > 10_000, 100.0).otherwise(1.0).alias("up_down_ratio"),
        F.lit(0).cast("long").alias("large_transfers"), F.lit(True).alias("direction_available"), (F.col("new_ip") == 1).alias("is_new_destination"),
    )
