"""Captures as a data source of Spark: read by byte ranges, in batch and as a stream, and written."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..cluster import ship_package
from .captures import MAGIC

SCHEMA = "file string, range int, place long, at long, ts timestamp, frame binary, captured long"
#: How many headers in a row must hold for a record to begin at some byte of a range.
CHAIN = 16
_TEN_YEARS = 10 * 366 * 86_400


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), f"/{path[5:].lstrip('/')}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, int]]:
    """``(path, size, time)`` of the files of a folder, of a pattern in one, or of one file, in order of time."""
    store, at = _open(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        folder, pattern = (at, "*") if info.type == fs.FileType.Directory else posixpath.split(at)
        entries = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = [f for f in entries if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))]
    return sorted(((prefix + f.path, f.size, f.mtime_ns or 0) for f in found), key=lambda x: (x[2], x[0]))


@dataclass
class ByteRange(InputPartition):
    """Records that begin in ``begin..end`` of a file of ``size`` bytes."""

    path: str
    number: int
    begin: int
    end: int
    size: int


def ranges_of(files: list[tuple[str, int, int]], step: int) -> list[ByteRange]:
    return [ByteRange(path, k, k * step, min(size, (k + 1) * step), size) for path, size, _ in files for k in range(max(1, -(-size // step)))]


class _Reader:
    """Bytes of a file by place, a few megabytes at a time."""

    def __init__(self, file, size: int, block: int = 4 << 20):
        self.file, self.size, self.block = file, size, block
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """``n`` bytes from ``at`` on, fewer at the end of the file."""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.block))
        return memoryview(self.held)[at - self.at : at - self.at + n]


class Capture:
    """One file: its header, and its records from any byte on."""

    def __init__(self, file, size: int):
        self.reader, self.size = _Reader(file, size), size
        head = bytes(self.reader.get(0, 24))
        if head[:4] not in MAGIC or len(head) < 24:
            raise ValueError("not a capture file")
        self.order, self.units = MAGIC[head[:4]]
        self.most, link = struct.unpack(self.order + "II", head[16:24])
        if link != 1:
            raise ValueError("only Ethernet captures can be read")
        self.most = max(self.most, 262_144)
        self.header = struct.Struct(self.order + "4I")
        self.first = self.header.unpack(self.reader.get(24, 16))[0] if size >= 40 else 0

    def sound(self, at: int) -> int | None:
        """Where the next record would begin if one began at ``at``; None if none can."""
        if at + 16 > self.size:
            return None
        seconds, part, size, whole = self.header.unpack(self.reader.get(at, 16))
        if part >= self.units or size > min(self.most, whole) or not (seconds or size) or abs(seconds - self.first) > _TEN_YEARS or at + 16 + size > self.size:
            return None
        return at + 16 + size

    def find(self, begin: int, end: int) -> int:
        """The first record that begins at ``begin`` or later.

        The search starts two records of the largest size before: payload may
        itself be a chain of records, but a chain that begins in a record's
        payload meets the file's own where that record ends. Near the file's
        begin the walk is from its first record.
        """
        at = max(24, begin - min(2 * self.most, 4 << 20))
        while at < end:
            here: int | None = at
            if at > 24:
                for _ in range(CHAIN):
                    here = self.sound(here)
                    if here is None or here == self.size:
                        break
            if here is not None:
                here = at
                while here is not None and here < begin:
                    after = self.sound(here)
                    if after is None and at == 24:  # not a false start: the file itself is malformed
                        raise ValueError("the capture ends inside a packet")
                    here = after
            if here is not None:
                return here
            at += 1
        raise ValueError("no record begins near a range of the capture")

    def records(self, begin: int, end: int) -> Iterator[tuple[int, int, memoryview]]:
        """``(at, time in µs, frame)`` of the records that begin in ``begin..end``; a malformed file is an error."""
        at = self.find(begin, end) if self.size > 24 else end
        while at < end:
            if at + 16 > self.size:
                raise ValueError("the capture ends inside a record header")
            seconds, part, size, _ = self.header.unpack(self.reader.get(at, 16))
            if at + 16 + size > self.size:
                raise ValueError("the capture ends inside a packet")
            yield at, seconds * 10**6 + part * 10**6 // self.units, self.reader.get(at + 16, size)
            at += 16 + size


def _read(part: ByteRange, max_len: int, batch: int) -> Iterator[pa.RecordBatch]:
    store, path = _open(part.path)
    with store.open_input_file(path) as file:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            at, us, frame, size, place = zip(*rows)
            n = len(rows)
            columns = [pa.array([part.path] * n), pa.array([part.number] * n, pa.int32()), pa.array(place, pa.int64()), pa.array(at, pa.int64()), pa.array(us, pa.timestamp("us", "UTC")), pa.array(frame, pa.binary()), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "range", "place", "at", "ts", "frame", "captured"])

        for place, (at, us, frame) in enumerate(Capture(file, part.size).records(part.begin, part.end)):
            rows.append((at, us, bytes(frame) if len(frame) <= max_len else None, len(frame), place))
            if len(rows) == batch:
                yield out()
                rows.clear()
        if rows:
            yield out()


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", 32 << 20))
        self.max_len, self.batch = int(options.get("maxLen", 262_144)), int(options.get("batchRows", 2000))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.max_len, self.batch)


class RangeReader(_Options, DataSourceReader):
    """A task for each ``rangeBytes`` of each file."""

    def partitions(self) -> list[ByteRange]:
        return ranges_of(listed(self.path), self.step)


class RangeStream(_Options, DataSourceStreamReader):
    """New files of a folder, in order of time and name, each by ranges.

    The offset is the time and name of the last file taken, so it does not
    grow. A file counts as whole when it is listed, as in Spark's own file
    source; files must appear in order of their times.
    """

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"time": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return ranges_of([f for f in listed(self.path) if after < (f[2], f[0]) <= upto], self.step)

    def commit(self, end: dict) -> None:
        pass


class CaptureWriter(DataSourceArrowWriter):
    """One capture a task from ``ts, frame``; a failed job's files are removed, a repeated task writes under another name."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        store, at = _open(self.path)
        if overwrite:
            for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.type == fs.FileType.File and f.base_name.endswith(".pcap"):
                    store.delete_file(f.path)
        store.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, at = _open(self.path)
        name = f"{at}/part-{uuid.uuid4().hex}.pcap"
        with store.open_output_stream(f"{at}/.{posixpath.basename(name)}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1))
            for batch in iterator:
                times = batch.column(batch.schema.get_field_index("ts")).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
                for us, frame in zip(times, batch.column(batch.schema.get_field_index("frame")).to_pylist()):
                    out.write(struct.pack("<4I", us // 10**6, us % 10**6, len(frame), len(frame)))
                    out.write(frame)
        written = WriterCommitMessage()
        written.name = name
        return written

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that count get their names; those of others keep a dot before them and are not read."""
        for m in filter(None, messages):
            store, name = _open(self.path)[0], m.name
            store.move(f"{posixpath.dirname(name)}/.{posixpath.basename(name)}", name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in filter(None, messages):
            _open(self.path)[0].delete_file(f"{posixpath.dirname(m.name)}/.{posixpath.basename(m.name)}")


class CaptureSource(DataSource):
    """``spark.read.format("capture")``: options ``rangeBytes``, ``maxLen``, ``batchRows``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> RangeStream:
        return RangeStream(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format ``capture``."""
    ship_package(spark)
    spark.dataSource.register(CaptureSource)
    return spark


def read_capture_ranges(spark: SparkSession, path: str, range_bytes: int = 32 << 20, max_len: int = 262_144) -> DataFrame:
    """``file, range, place, at, ts, frame, captured`` of all captures under a path, each file by byte ranges.

    ``at`` is the byte where the record begins, ``place`` counts within the
    range. A range finds its first record by a walk along headers that hold,
    from some records before it; ``numbered`` makes sure of it. The files' store must be one that Arrow
    opens; ``read_captures`` reads whole files by Spark's own reader.
    """
    return registered(spark).read.format("capture").option("rangeBytes", range_bytes).option("maxLen", max_len).load(path)


def stream_captures(spark: SparkSession, folder: str, range_bytes: int = 32 << 20, max_len: int = 262_144) -> DataFrame:
    """The same for a folder that captures arrive in, as a stream."""
    return registered(spark).readStream.format("capture").option("rangeBytes", range_bytes).option("maxLen", max_len).load(folder)


def numbered(records: DataFrame) -> DataFrame:
    """Records of byte ranges with ``rec_no``, their number in the file, in place of ``range, place``.

    A table of a row for each range gives how many records come before it,
    and is held to this: a range's first record begins where the last one of
    the range before ends, the first of all at the header's end. Anything
    else (a range that took payload for headers) is an error, not a result.
    """
    ends = records.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max(F.col("at") + 16 + F.col("captured")).alias("end"))
    by_file = Window.partitionBy("file").orderBy("range")
    sound = F.col("first") == F.coalesce(F.lag("end").over(by_file), F.lit(24))
    before = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("file", "range", F.when(sound, before).otherwise(F.raise_error(F.concat(F.lit("ranges do not join in "), "file"))).alias("before"))
    return records.join(starts, ["file", "range"]).withColumn("rec_no", F.col("before") + F.col("place")).drop("range", "place", "before")


def write_captures(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``ts, frame`` as captures, one for each partition."""
    registered(frames.sparkSession)
    frames.select("ts", "frame").write.format("capture").mode("overwrite" if overwrite else "append").save(path)


def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def encode_frames(packets: DataFrame) -> DataFrame:
    """``ts, frame`` of IPv4 packets: Ethernet, IP and TCP or UDP headers, padded with zeros to the packet's length.

    The reverse of ``decode_frames``; checksums and sequence numbers are 0.
    An address that is not of four bytes is an error.
    """
    byte = lambda c: lambda x: F.when(x.cast("long").between(0, 255), _hex(x, 2)).otherwise(F.raise_error(F.concat(F.lit("not an IPv4 address: "), F.col(c))).cast("string"))
    ip = lambda c: F.array_join(F.transform(F.split(F.col(c), r"\."), byte(c)), "")
    bits = {"tcp_fin": 1, "tcp_syn": 2, "tcp_rst": 4, "tcp_psh": 8, "tcp_ack": 16, "tcp_urg": 32}
    flags = sum((F.col(c) * b for c, b in bits.items()), F.lit(0))
    size, tcp, udp = F.col("packet_length"), F.col("protocol") == 6, F.col("protocol") == 17
    ports = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4))
    body = F.when(tcp, F.concat(ports, F.lit("0" * 16 + "50"), _hex(flags, 2), F.lit("0" * 12))).when(udp, F.concat(ports, _hex(size - 20, 4), F.lit("0000"))).otherwise("")
    head = F.concat(F.lit("0" * 24 + "08004500"), _hex(size, 4), F.lit("0000000040"), _hex(F.col("protocol"), 2), F.lit("0000"), ip("src_ip"), ip("dst_ip"), body)
    return packets.select("ts", F.unhex(F.rpad(head, (14 + size).cast("int") * 2, "0")).alias("frame"))
