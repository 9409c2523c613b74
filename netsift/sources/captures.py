"""Packet captures as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The first four bytes of a capture file, as byte order and units a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
# EtherTypes.
VLAN, IPV4, IPV6 = (0x8100, 0x88A8, 0x9100), 0x0800, 0x86DD


def _records(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, time in µs, frame) of a classic capture; a malformed file is an error."""
    if content[:4] not in MAGIC or len(content) < 24:
        raise ValueError("not a capture file")
    order, units = MAGIC[content[:4]]
    if struct.unpack(order + "I", content[20:24])[0] != 1:
        raise ValueError("only Ethernet captures can be read")
    at, number = 24, 0
    while at < len(content):
        if at + 16 > len(content):
            raise ValueError("the capture ends inside a record header")
        seconds, part, size, _ = struct.unpack_from(order + "4I", content, at)
        at += 16
        if at + size > len(content):
            raise ValueError("the capture ends inside a packet")
        yield number, seconds * 10**6 + part * 10**6 // units, content[at : at + size]
        at, number = at + size, number + 1


def read_captures(spark: SparkSession, path: str, max_len: int = 262_144, batch: int = 2000) -> DataFrame:
    """``file, rec_no, ts, frame, captured`` of all captures under a path, read by Spark's reader.

    Frames over ``max_len`` bytes are null, their size stays in ``captured``,
    so that they are counted but not carried.
    """

    def run(batches):
        def out(rows):
            file, no, us, frame, size = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(no, pa.int64()), pa.array(us, pa.timestamp("us", "UTC")), pa.array(frame, pa.binary()), pa.array(size, pa.int64())], names=["file", "rec_no", "ts", "frame", "captured"])

        for files in batches:
            for name, content in zip(files.column(0), files.column(1)):
                rows = []
                for no, us, frame in _records(content.as_py()):
                    rows.append((name.as_py(), no, us, frame if len(frame) <= max_len else None, len(frame)))
                    if len(rows) == batch:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, rec_no long, ts timestamp, frame binary, captured long")


def _number(data: str, at, size: int) -> Column:
    """A big-endian number of ``size`` bytes at a zero-based place."""
    return F.conv(F.hex(F.substring(F.col(data), F.lit(1) + at, F.lit(size))), 16, 10).cast("long")


def _ipv6_groups(hexed: Column) -> Column:
    """The eight groups without leading zeros."""
    groups = [F.coalesce(F.nullif(F.regexp_replace(F.lower(F.substring(hexed, 1 + 4 * k, 4)), "^0+", ""), F.lit("")), F.lit("0")) for k in range(8)]
    return F.concat_ws(":", *groups)


def _ipv6_text(plain: Column) -> Column:
    """RFC 5952 text of the groups: the first longest run of zeros cut."""
    out = F
    for n in range(8, 1, -1):
        pattern = rf"^(|.*?:)0(?::0){{{n - 1}}}(?![0-9a-f])(.*)$"
        short = F.concat(F.regexp_replace(F.regexp_extract(plain, pattern, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(plain, pattern, 2), "^:", ""))
        out = out.when(plain.rlike(pattern), short)
    return out.otherwise(plain)


def decode_frames(frames: DataFrame, max_tags: int = 3) -> DataFrame:
    """Ethernet frames to packets, in expressions only; what is malformed or of another kind is dropped.

    Up to ``max_tags`` VLAN tags; IPv4 and IPv6; ports of TCP and UDP; the
    packet length is IP's total length.
    """
    size = F.length("frame")
    two = lambda at: F.substring(F.col("frame"), at, F.lit(2))
    is_type = lambda at, *types: two(at).isin(*(F.lit(bytearray(t.to_bytes(2))) for t in types))

    def with_values(df: DataFrame, **values: Column) -> DataFrame:
        """Columns that stand for themselves: what is made of them, and filters on them too, does not repeat what they are made of."""
        return df.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))

    tags = F.lit(max_tags)
    for k in reversed(range(max_tags)):
        tags = F.when(is_type(F.lit(13 + 4 * k), *VLAN) & (size >= 18 + 4 * k), tags).otherwise(k)
    steps = with_values(frames.where(F.col("frame").isNotNull() & (size >= 14)), __at=14 + 4 * tags)
    at = F.col("__at")
    steps = with_values(steps, __v4=is_type(at - 1, IPV4), __v6=is_type(at - 1, IPV6), __first=_number("frame", at, 1))
    v4, v6, first = F.col("__v4"), F.col("__v6"), F.col("__first")
    header = F.when(v4, first.bitwiseAND(F.lit(15)) * 4).otherwise(40)
    total = F.when(v4, _number("frame", at + 2, 2)).otherwise(40 + _number("frame", at + 4, 2))
    steps = steps.where((v4 & (size - at >= 20) & (F.shiftright(first, 4) == 4)) | (v6 & (size - at >= 40) & (F.shiftright(first, 4) == 6)))
    steps = with_values(steps, __head=header, packet_length=total, protocol=F.when(v4, _number("frame", at + 9, 1)).otherwise(_number("frame", at + 6, 1)).cast("int"))
    steps = steps.where((F.col("__head") >= 20) & (F.col("packet_length") >= F.col("__head")) & (F.col("packet_length") <= size - at))
    body, room = at + F.col("__head"), F.col("packet_length") - F.col("__head")
    tcp, udp = F.col("protocol") == 6, F.col("protocol") == 17
    offset = F.shiftright(_number("frame", body + 12, 1), 4) * 4
    sound = F.when(tcp, (room >= 20) & (offset >= 20) & (offset <= room)).when(udp, (room >= 8) & _number("frame", body + 4, 2).between(F.lit(8), room)).otherwise(True)
    quad = lambda p: F.concat_ws(".", *(_number("frame", at + p + k, 1).cast("string") for k in range(4)))
    six = lambda p: _ipv6_groups(F.hex(F.substring(F.col("frame"), F.lit(1) + at + p, F.lit(16))))
    port = lambda p: F.when(tcp | udp, _number("frame", body + p, 2)).otherwise(0).cast("int")
    steps = with_values(steps.where(sound), __src=F.when(v4, quad(12)).otherwise(six(8)), __dst=F.when(v4, quad(16)).otherwise(six(24)), __flags=F.when(tcp, _number("frame", body + 13, 1)).otherwise(0))
    text = lambda c: F.when(v4, F.col(c)).otherwise(_ipv6_text(F.col(c)))
    bits = {"tcp_fin": 1, "tcp_syn": 2, "tcp_rst": 4, "tcp_psh": 8, "tcp_ack": 16, "tcp_urg": 32}
    carried = [c for c in ("file", "rec_no", "ts") if c in frames.columns]
    return steps.select(
        *carried, text("__src").alias("src_ip"), port(0).alias("src_port"), text("__dst").alias("dst_ip"), port(2).alias("dst_port"),
        "protocol", "packet_length", *((F.col("__flags").bitwiseAND(F.lit(b)) > 0).cast("long").alias(n) for n, b in bits.items()),
    )


def ingestion_stats(records: DataFrame, packets: DataFrame) -> DataFrame:
    """Records seen, too large, yielded and rejected."""
    seen = records.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("frame").isNull()).alias("too_large"))
    return seen.join(F.broadcast(packets.agg(F.count(F.lit(1)).alias("yielded")))).withColumn("rejected", F.col("seen") - F.col("yielded"))


def observed_packets(records: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The packets of the records, and a call that gives what ``ingestion_stats`` counts, observed while they were written.

    The counts are those of the first action on the packets; no pass of their
    own reads the captures again. The call waits for that action.
    """
    read, told = Observation(), Observation()
    seen = records.observe(read, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("frame").isNull()).alias("too_large"))
    packets = decode_frames(seen).observe(told, F.count(F.lit(1)).alias("yielded"))

    def stats() -> dict[str, int]:
        found = {**read.get, **told.get}
        return found | {"rejected": found["seen"] - found["yielded"]}

    return packets, stats
