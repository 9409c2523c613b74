"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.flows import FIVE, FLAGS
from .processors import Bucketed, EntityContext, EntityContexts, FirstCrossing, Throttle, TrailingCounts, keyed


def stream_flows(packets: DataFrame, gap: str = "30 seconds", watermark: str = "30 seconds") -> DataFrame:
    """Flows as sessions in event time, each emitted when the watermark passes its end; later packets are dropped."""
    sums = [F.sum(f"tcp_{f}").alias(f"{f}_count") for f in FLAGS]
    g = packets.withWatermark("ts", watermark).groupBy(*FIVE, F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_count"), *sums, F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("session_window")


def stream_window(packets: DataFrame, width: str, slide: str | None = None, key: tuple[str, ...] = ("src_ip",), watermark: str = "30 seconds") -> DataFrame:
    """Counts and bytes over hopping windows (tumbling without ``slide``).

    The batch windows end at each packet; these end at each slide.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = packets.withWatermark("ts", watermark).groupBy(*key, w)
    return g.agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"), F.sum("tcp_syn").alias("syn")).select(*key, "window.start", "window.end", "packets", "bytes", "syn")


def stream_correlate(signals: DataFrame, gap: str = "300 seconds", watermark: str = "300 seconds") -> DataFrame:
    """Correlation groups: an entity's signals until it is idle for longer than the gap."""
    g = signals.withWatermark("ts", watermark).groupBy("entity", F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("signals"), F.max("confidence").alias("confidence"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def stream_throttle(df: DataFrame, key: str, seconds: float = 1.0, ttl_seconds: float = 900.0, watermark: str = "30 seconds") -> DataFrame:
    """Events at least ``seconds`` after the last kept of their key; keys idle past the TTL are forgotten."""
    return keyed(df.select(key, "seq", "ts"), [key], Throttle(key, seconds, ttl_seconds), f"{key} string, seq long, ts timestamp", watermark)


def stream_first_crossing(packets: DataFrame, n: int = 20, ttl_seconds: float = 900.0, watermark: str = "30 seconds", buckets: int = 1024) -> DataFrame:
    """One event per flow id at its n-th packet, once; flows idle past the TTL are forgotten. State is kept by so many buckets of flows."""
    columns = "src_ip string, src_port int, dst_ip string, dst_port int, protocol int, ts timestamp, packet_count long, byte_count long"
    crossing = FirstCrossing(list(FIVE), n, ttl_seconds)
    flow = F.to_json(F.array(*(F.col(c).cast("string") for c in FIVE)))
    rows = packets.select(*FIVE, "seq", "ts", "packet_length", flow.alias("flow"), F.pmod(F.xxhash64(*FIVE), F.lit(buckets)).alias("bucket"))
    return rows.withWatermark("ts", watermark).groupBy("bucket").applyInPandasWithState(crossing, columns, crossing.STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _bucketed(rows: DataFrame, trailing: Bucketed, key: str, columns: str, watermark: str, buckets: int) -> DataFrame:
    """Rows of ``host`` through a trailing frame, whose state is kept by so many buckets of hosts."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets))).withWatermark("ts", watermark)
    told = rows.groupBy("bucket").applyInPandasWithState(trailing, f"host string, seq long, {columns}", trailing.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumnRenamed("host", key)


def stream_trailing(packets: DataFrame, seconds: float = 5.0, key: str = "src_ip", ttl_seconds: float = 900.0, watermark: str = "30 seconds", buckets: int = 1024) -> DataFrame:
    """Packets, bytes, SYN, ACK and rate of the exact trailing window after each packet.

    The window ends at the largest time that the key has seen in order of
    arrival (``seq``). Late packets within the watermark count while they lie
    inside; older ones are dropped. State is kept by so many buckets of keys.
    """
    rows = packets.select(F.col(key).alias("host"), "seq", "ts", "packet_length", "tcp_syn", "tcp_ack")
    return _bucketed(rows, TrailingCounts(seconds, ttl_seconds), key, "end_ts timestamp, packets long, bytes long, syn long, ack long, rate double", watermark, buckets)


def stream_entity_context(entity_flows: DataFrame, retention_seconds: float = 300.0, ttl_seconds: float = 900.0, watermark: str = "30 seconds", buckets: int = 1024) -> DataFrame:
    """Trailing counts per entity after each of its flows; state holds the rows of the retention time only.

    State is kept by so many buckets of entities, each written whole when a
    batch touches it. With no buckets each entity has its own, of which a
    batch writes only the times that its rows fall into: for few entities
    with many rows in a frame.
    """
    columns = "flows_out long, bytes_out long, bytes_in long, distinct_dst_ips long"
    rows = entity_flows.select("entity", "seq", "ts", "byte_count", "outbound", "dst_ip")
    if not buckets:
        return keyed(rows, ["entity"], EntityContext(retention_seconds, ttl_seconds), f"entity string, seq long, {columns}", watermark)
    return _bucketed(rows.withColumnRenamed("entity", "host"), EntityContexts(retention_seconds, ttl_seconds), "entity", columns, watermark, buckets)


def push(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Hand every micro-batch to ``sink``: alerts, events or snapshots; all that is there, or by a trigger of one's own as batches come.

    A batch whose sink or process failed is handed on again under the same
    number; ``push_table`` is a sink that such a batch writes to once.
    """
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def push_table(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append every micro-batch to a table exactly once, whatever fails in between.

    A batch's rows go to a folder of its number, then its line to a ledger.
    A batch that comes again is skipped if the ledger has it, and else
    overwrites what it left; readers take only folders that the ledger has.
    """

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if number in _ledger(spark, path):
            return
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        line = spark.createDataFrame([(number, rows.get["n"])], LEDGER)
        line.coalesce(1).write.mode("overwrite").json(f"{path}/ledger/{number}")

    return push(stream, write, checkpoint, **trigger)


LEDGER = "batch long, rows long"


def _ledger(spark: SparkSession, path: str) -> set[int]:
    """The batches that were written whole: one small file each."""
    try:
        return {r["batch"] for r in spark.read.schema(LEDGER).json(f"{path}/ledger/*").collect()}
    except AnalysisException:  # no batch yet
        return set()


def pushed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that the ledger has, with their batch's number."""
    done = spark.read.schema(LEDGER).json(f"{path}/ledger/*").select(F.col("batch").alias("__done"))
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows")
    return rows.join(done, F.col("batch") == F.col("__done"), "left_semi")
