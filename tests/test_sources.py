import socket
import struct

import pytest
from pyspark.sql import functions as F

from netsift.plans.streams import drained
from netsift.sources import capture_source as K
from netsift.sources import captures as P
from netsift.sources import tables as B


def frame(v6=False, tags=0, proto=6, flags=0x12, cut=0):
    body = struct.pack("!HHIIBBHHH", 1234, 80, 0, 0, 5 << 4, flags, 0, 0, 0) if proto == 6 else struct.pack("!HHHH", 53, 5353, 8, 0)
    if v6:
        ip = struct.pack("!IHBB", 6 << 28, len(body), proto, 64) + socket.inet_pton(socket.AF_INET6, "2001:db8::1") + socket.inet_pton(socket.AF_INET6, "::")
    else:
        ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, socket.inet_aton("10.1.2.3"), socket.inet_aton("10.4.5.6"))
    data = b"\0" * 12 + b"\x81\x00\0\1" * tags + struct.pack("!H", 0x86DD if v6 else 0x0800) + ip + body
    return data[: len(data) - cut] if cut else data


def capture(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 5000 if nano else 5, len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    frames = [frame(), frame(tags=2), frame(v6=True), frame(proto=17), frame(cut=3), b"\0" * 300]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:1], ">", nano=True))
    records = P.read_captures(spark, f"{tmp_path}/*.pcap", max_len=200)
    packets = P.decode_frames(records)
    rows = {(r.file[-6:], r.rec_no): r for r in packets.collect()}
    assert sorted(rows) == [("a.pcap", 0), ("a.pcap", 1), ("a.pcap", 2), ("a.pcap", 3), ("b.pcap", 0)]
    a = rows["a.pcap", 0]
    assert (a.src_ip, a.src_port, a.dst_ip, a.dst_port, a.protocol, a.packet_length, a.tcp_syn, a.tcp_ack, a.tcp_fin) == ("10.1.2.3", 1234, "10.4.5.6", 80, 6, 40, 1, 1, 0)
    assert rows["a.pcap", 2].src_ip == "2001:db8::1" and rows["a.pcap", 2].dst_ip == "::" and rows["a.pcap", 3].src_port == 53
    assert rows["b.pcap", 0].ts.microsecond == 5
    stats = P.ingestion_stats(records, packets).first()
    assert (stats.seen, stats.too_large, stats.yielded, stats.rejected) == (7, 1, 5, 2)


def test_malformed_captures_are_errors():
    import pytest

    for bad in (b"nothing", capture([frame()])[:-3], capture([frame()])[:30]):
        with pytest.raises(ValueError):
            list(P._records(bad))


def test_manifest_and_alerts(spark, tmp_path):
    import json

    event = {"event_id": "e1", "traffic_class": "RECON", "source_ips": ["a"], "time_window": {"start_time_iso": "2024-01-01T00:00:10Z", "end_time_iso": "2024-01-01T00:02:00Z"}}
    (tmp_path / "m.json").write_text(json.dumps({"captures": {"c1": {"primary_label": "RECON", "split": "test", "capture_start_iso": "2024-01-01T00:00:00Z", "capture_end_iso": "2024-01-01T00:01:00Z", "labeled_events": [event]}}}))
    captures, events, problems = B.read_manifest(spark, f"{tmp_path}/m.json")
    assert captures.count() == 1 and events.first().event_id == "e1" and [r.problem for r in problems.collect()] == ["event outside its capture"]
    lines = spark.createDataFrame([('{"alert_id": "x", "confidence": 0.5}',)], "value string")
    assert B.alerts_from_json(lines).first().confidence == 0.5


def mixed(n):
    """Frames of many sizes, some of which hold whole records as their payload."""
    own = capture([frame(), frame(v6=True)])[24:]
    return [frame() + (own * (i % 7) if i % 3 == 0 else bytes([i % 251]) * (i % 1400)) for i in range(n)]


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", True)])
def test_ranges_equal_the_whole_read(spark, tmp_path, order, nano):
    (tmp_path / "a.pcap").write_bytes(capture(mixed(3000), order, nano))
    (tmp_path / "b.pcap").write_bytes(capture(mixed(5), order, nano))
    (tmp_path / "empty.pcap").write_bytes(capture([], order, nano))
    want = sorted((r.file[-6:], r.rec_no, r.ts, bytes(r.frame) if r.frame else None, r.captured) for r in P.read_captures(spark, f"{tmp_path}/*.pcap", max_len=1200).collect())
    for step in (20_000, 300_000, 1 << 25):
        records = K.read_capture_ranges(spark, f"{tmp_path}/*.pcap", step, max_len=1200)
        got = K.numbered(records)
        assert sorted((r.file[-6:], r.rec_no, r.ts, bytes(r.frame) if r.frame else None, r.captured) for r in got.collect()) == want
        assert step > 20_000 or records.rdd.getNumPartitions() > 50
    stats = P.ingestion_stats(records, P.decode_frames(records)).first()
    assert stats.seen == 3005 and stats.too_large > 0


def test_payload_that_looks_like_records(spark, tmp_path):
    # chains of records as payload, some to the end of their frame, in a file of many times the walk before a range
    trap = capture([frame()] * 40)[24:]
    frames = [frame() + trap + b"x" * (i % 3) if i % 2 else frame() for i in range(600)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    want = [(r.rec_no, bytes(r.frame)) for r in P.read_captures(spark, f"{tmp_path}/a.pcap").orderBy("rec_no").collect()]
    records = K.read_capture_ranges(spark, f"{tmp_path}/a.pcap", 100_000)
    assert [(r.rec_no, bytes(r.frame)) for r in K.numbered(records).orderBy("rec_no").collect()] == want and len(want) == 600
    # ranges that do not join are an error
    with pytest.raises(Exception, match="ranges do not join"):
        K.numbered(records.where("range <> 3 or place > 0")).collect()
    for bad in (b"nothing", capture([frame()])[:-3], capture([frame()])[:30]):
        (tmp_path / "bad.pcap").write_bytes(bad)
        for step in (20, 1 << 20):
            with pytest.raises(Exception, match="capture"):
                K.read_capture_ranges(spark, f"{tmp_path}/bad.pcap", step).collect()


def test_captures_written_and_streamed(spark, tmp_path):
    from tests.test_flows_windows import packets

    p = packets(spark, [0, 1, (2, 900)], tcp_syn=1).unionByName(packets(spark, [5], protocol=17)).withColumn("packet_length", F.greatest("packet_length", F.lit(40)))
    K.write_captures(K.encode_frames(p.repartition(2)), f"{tmp_path}/out")
    columns = [c for c in p.columns if c not in ("seq", "tcp_payload")]
    back = P.decode_frames(K.numbered(K.read_capture_ranges(spark, f"{tmp_path}/out")))
    columns = [c for c in columns if c in back.columns]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, p.select(columns).collect())) and len(columns) > 8
    # a stream takes each file once, and those that come later in the next run
    stream = lambda: K.stream_captures(spark, f"{tmp_path}/out", 64).select("at", "captured")
    run = lambda: stream().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/got").trigger(availableNow=True).start().awaitTermination(120)
    assert run() and spark.read.parquet(f"{tmp_path}/got").count() == 4
    K.write_captures(K.encode_frames(p.limit(2).coalesce(1)), f"{tmp_path}/out")
    assert run() and spark.read.parquet(f"{tmp_path}/got").count() == 6
    assert drained(stream()).count() == 6
    K.write_captures(K.encode_frames(p.limit(1)), f"{tmp_path}/out", overwrite=True)
    assert K.read_capture_ranges(spark, f"{tmp_path}/out").count() == 1


def test_decoding_compiles(spark):
    """Steps that repeated what they are made of grew beyond what Java compiles, and were interpreted row by row."""
    rows = [(frame(v6, tags, proto),) for v6 in (False, True) for tags in range(4) for proto in (6, 17)]
    read = spark.createDataFrame(rows, "frame binary").repartition(2)
    before = spark.conf.get("spark.sql.codegen.fallback")
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        got = P.decode_frames(read).collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
    assert sorted((r.src_ip, r.src_port, r.protocol) for r in got) == sorted((ip, *p) for ip in ("10.1.2.3", "2001:db8::1") for p in ((1234, 6), (53, 17)) for _ in range(4))
