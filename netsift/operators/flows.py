"""Packets to 5-tuple flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIVE = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")


def with_flow_id(df: DataFrame) -> DataFrame:
    """Add the text key ``src:port-dst:port-protocol``."""
    return df.withColumn("flow_id", F.format_string("%s:%s-%s:%s-%s", *(F.col(c).cast("string") for c in FIVE)))


def sessions(packets: DataFrame, gap_seconds: float, key: tuple[str, ...] = FIVE) -> DataFrame:
    """Number the sessions of each key: a pause longer than the gap begins the next."""
    order = Window.partitionBy(*key).orderBy("ts", "seq")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    return packets.withColumn("session", F.sum((F.coalesce(pause, F.lit(0)) > int(gap_seconds * 1e6)).cast("int")).over(order))


def build_flows(packets: DataFrame, gap: str = "30 seconds", key: tuple[str, ...] = FIVE) -> DataFrame:
    """One row per 5-tuple and session: packets, bytes, flag sums, start and end.

    Session windows merge map-side, so a flooding key does not move its
    packets. A pause of exactly the gap stays in the flow.
    """
    sums = [F.sum(f"tcp_{f}").alias(f"{f}_count") for f in FLAGS]
    grouped = packets.groupBy(*key, F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_count"), *sums, F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("session_window")


def flow_rates(flows: DataFrame) -> DataFrame:
    """Duration, packet and byte rates (0 for no duration) and flag ratios."""
    seconds = F.greatest((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6, F.lit(0.0))
    zero = F.lit(0.0)
    return flows.withColumn("duration_sec", seconds).withColumns(
        {"packet_rate": F.coalesce(F.try_divide("packet_count", "duration_sec"), zero), "byte_rate": F.coalesce(F.try_divide("byte_count", "duration_sec"), zero)}
        | {f"{f}_ratio": F.coalesce(F.try_divide(f"{f}_count", "packet_count"), zero) for f in ("syn", "ack", "fin", "rst")}
    )


def flow_sequences(packets: DataFrame, k: int = 20, gap_seconds: float = 30.0, key: tuple[str, ...] = FIVE) -> DataFrame:
    """Per flow: the first ``k`` packet lengths and the last ``k`` inter-arrival times in ms.

    Only rows within ``k`` of a flow's ends are gathered, so that no group is
    longer than 2k whatever the flow's size.
    """
    up = Window.partitionBy(*key, "session").orderBy("ts", "seq")
    down = Window.partitionBy(*key, "session").orderBy(F.desc("ts"), F.desc("seq"))
    gap_ms = F.greatest((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(up)) / 1000, F.lit(0.0))
    numbered = sessions(packets, gap_seconds, key).withColumn("iat_ms", gap_ms).withColumn("__no", F.row_number().over(up)).withColumn("__rev", F.row_number().over(down)).where((F.col("__no") <= k) | (F.col("__rev") <= k))
    lengths = F.array_sort(F.collect_list(F.when(F.col("__no") <= k, F.struct("__no", F.col("packet_length").alias("x")))))
    iats = F.array_sort(F.collect_list(F.when((F.col("__rev") <= k) & F.col("iat_ms").isNotNull(), F.struct("__no", F.col("iat_ms").alias("x")))))
    return numbered.groupBy(*key, "session").agg(lengths.alias("l"), iats.alias("i")).select(*key, "session", F.transform("l", lambda e: e["x"]).alias("packet_lengths"), F.transform("i", lambda e: e["x"]).alias("inter_arrival_times_ms"))


def sequence_stats(array, prefix: str) -> list[Column]:
    """Minimum, maximum, mean and population standard deviation of an array; 0 where it is empty."""
    a = F.transform(F.col(array), lambda x: x.cast("double"))
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    spread = F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n))
    zero = F.lit(0.0)
    return [F.coalesce(F.array_min(a), zero).alias(f"{prefix}_min"), F.coalesce(F.array_max(a), zero).alias(f"{prefix}_max"), mean.alias(f"{prefix}_mean"), F.when(n < 2, 0.0).otherwise(spread).alias(f"{prefix}_std")]


def flow_event_features(flows: DataFrame) -> DataFrame:
    """Features of single flows: rates with no duration counted as one second; the SYN ratio for TCP only."""
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    seconds = F.when(seconds > 0, seconds).otherwise(1.0)
    ratio = F.when(F.col("protocol") == 6, F.coalesce(F.try_divide("syn_count", "packet_count"), F.lit(0.0)))
    one = F.lit(1).cast("long")
    return flows.withColumns({"packets_per_sec": F.col("packet_count") / seconds, "bytes_per_sec": F.col("byte_count") / seconds, "syn_ratio": ratio, "dst_ip_cardinality": one, "dst_port_cardinality": one})


def normalize_flow_events(events: DataFrame) -> DataFrame:
    """Streaming flow events to feature flows: ISO times, and a flags struct for TCP only."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    flags = F.when(F.col("protocol") == 6, F.struct(*(F.col(f"{f}_count").alias(f) for f in FLAGS)))
    return with_flow_id(events).select("flow_id", *FIVE, F.date_format("start_ts", iso).alias("start_time_iso"), F.date_format("end_ts", iso).alias("end_time_iso"), "packet_count", "byte_count", flags.alias("tcp_flags"))


def failed_connection(rule: str = "reset") -> Column:
    """A flow that likely failed.

    ``reset``: no bytes, or a reset and under 64 bytes; ``tcp_reset``: the
    same for TCP only; ``half_open``: no bytes, or SYN without ACK.
    """
    if rule == "half_open":
        return (F.col("byte_count") == 0) | ((F.col("syn_count") > 0) & (F.col("ack_count") == 0))
    reset = (F.col("rst_count") > 0) & (F.col("byte_count") < 64)
    return (F.col("byte_count") == 0) | (reset & (F.col("protocol") == 6) if rule == "tcp_reset" else reset)


def flow_direction(entity) -> Column:
    e = F.col(entity) if isinstance(entity, str) else entity
    return F.when(F.col("src_ip") == e, "OUT").when(F.col("dst_ip") == e, "IN").otherwise("NONE")


def explode_entities(flows: DataFrame) -> DataFrame:
    """Each flow once for its source (outbound) and once for its destination (inbound), without a join."""
    ends = F.array(F.struct(F.col("src_ip").alias("entity"), F.lit(True).alias("outbound")), F.struct(F.col("dst_ip").alias("entity"), F.lit(False).alias("outbound")))
    return flows.select("*", F.explode(ends).alias("__e")).select(*flows.columns, "__e.entity", "__e.outbound")


def distinct_entities(flows: DataFrame) -> DataFrame:
    return flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("entity")).distinct()


def attach_flow_state(packets: DataFrame, flows: DataFrame, key: tuple[str, ...] = FIVE) -> DataFrame:
    """Packets with their flow's columns; packets without a flow are dropped."""
    extra = [c for c in flows.columns if c in key or c not in packets.columns]
    return packets.join(flows.select(*extra), list(key))


def first_flow_crossing(packets: DataFrame, n: int = 20, gap_seconds: float = 30.0, key: tuple[str, ...] = FIVE) -> DataFrame:
    """One event per flow at its n-th packet, with the counts so far."""
    order = Window.partitionBy(*key, "session").orderBy("ts", "seq")
    soFar = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = sessions(packets, gap_seconds, key).withColumns({"packet_count": F.row_number().over(order), "byte_count": F.sum("packet_length").over(soFar), "syn_count": F.sum("tcp_syn").over(soFar), "start_ts": F.min("ts").over(soFar)})
    return numbered.where(F.col("packet_count") == n).select(*key, "session", "start_ts", F.col("ts").alias("end_ts"), "packet_count", "byte_count", "syn_count")
