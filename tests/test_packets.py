import struct

import numpy as np
from pyspark.sql import functions as F

from cirrostrat.functions import binary as B
from cirrostrat.operators import decode, frames, pack
from cirrostrat.sources import capture, files, streams


def msop(count, blocks=((510, (16384, 16384, 23170), 9, 0),)):
    body = b"".join(struct.pack(">HHhhhBB", 0, r, *d, i, a) for r, d, i, a in blocks).ljust(96 * 12, b"\0")
    return decode.MSOP_SYNC + struct.pack(">H", count) + b"\0\0\x04\0" + (1).to_bytes(6, "big") + struct.pack(">I", 5) + b"\0" * 11 + bytes([100]) + body + b"\0" * 16


def test_pcap_ports_and_fragments(spark, tmp_path):
    big = bytes(range(256)) * 8
    links = capture.ethernet_udp(b"one", src_port=6699, dst_port=12345) + capture.ethernet_udp(big, ident=7, mtu=600)[::-1] + capture.ethernet_udp(big, ident=8, mtu=600)[:-1] + capture.ethernet_udp(b"")
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap([(i * 1_000_000_000, x) for i, x in enumerate(links)]) + b"\1\2\3")
    rows = capture.read_packets(spark, str(tmp_path)).orderBy("capture_seq").collect()
    assert [bytes(r["payload"]) for r in rows if r["error"] is None] == [b"one", big]
    assert [r["error"] for r in rows if r["error"]] == ["fragments missing"]
    assert [capture.read_packets(spark, str(tmp_path), p).where("error is null").count() for p in (6699, 12345, 9999)] == [2, 1, 0]
    spark.dataSource.register(capture.PcapDataSource)
    assert spark.read.format("pcap").option("path", str(tmp_path / "*.pcap")).load().count() == len(links)


def test_pcapng():
    link = capture.ethernet_udp(b"hi")[0]
    pad = b"\0" * (-len(link) % 4)
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(6, struct.pack("<IIIII", 0, 0, 5, len(link), len(link)) + link + pad) + block(3, struct.pack("<I", len(link)) + link + pad)
    assert list(capture.records(data)) == [(5000, link), (None, link)]


def test_msop(spark):
    good = msop(3, ((1020, (16384, 16384, 23170), 9, 0), (0, (1, 1, 1), 1, 0), (100, (1, 1, 1), 1, 2)))
    p = streams.finite(spark, [good, b"short", b"\0" * 1200])
    h = decode.decode_msop_headers(p).orderBy("capture_seq").collect()
    assert (h[0]["pkt_cnt"], h[0]["return_mode"], h[0]["header_ns"], h[0]["temperature"], h[0]["error"]) == (3, "Strongest", 1_000_005_000, 20, None)
    assert [r["error"] for r in h[1:]] == ["short packet", "bad sync"]
    points = decode.decode_msop_points(p).collect()
    assert len(points) == 1 and np.allclose([points[0][c] for c in "xyz"], [2.55, 2.55, 3.606], atol=0.01)
    assert decode.decode_msop_points(p, include_noisy=True).count() == 2


def test_difop(spark):
    raw = bytearray(256)
    raw[:8], raw[16:19], raw[20:26], raw[44:48], raw[62:64] = decode.DIFOP_SYNC, b"\1\2\3", b"\xab\0\0\0\0\1", b"\x0a\0\0\x05", b"\x1a\x2b"
    raw[208:232] = struct.pack(">6f", 0, 0, -9.5, 1, 2, 3)
    bad = bytearray(raw)
    bad[208:212] = struct.pack(">f", float("nan"))
    rows = decode.decode_difop(streams.finite(spark, [bytes(raw), bytes(bad), b"x"])).orderBy("capture_seq").collect()
    assert (rows[0]["version"], rows[0]["serial"], rows[0]["lidar_ip"], rows[0]["msop_port"], rows[0]["accel_z"]) == ("1.2.3", "AB0000000001", "10.0.0.5", 6699, -9.5)
    assert rows[1]["accel_z"] is None and rows[1]["error"] is None and rows[2]["error"] == "short packet"


def test_ouster_pixels(spark):
    column = lambda m, ok, px: struct.pack("<QHBB", 77, m, ok, 0) + b"".join(struct.pack("<HBB", *p) for p in px)
    raw = struct.pack("<HH", 1, 9).ljust(32, b"\0") + column(5, 1, [(0x8000 | 100, 7, 1), (200, 8, 1)]) + column(6, 0, [(1, 1, 1)] * 2)
    p = streams.finite(spark, [raw, b"\2\0" + raw[2:]])
    assert decode.decode_ouster_headers(p).where("error is null").first()["header_frame_id"] == 9
    got = [(r["row"], r["col"], r["depth"], r["reflect"]) for r in decode.decode_ouster_pixels(p, 2, 10, 2).orderBy("row").collect()]
    assert got == [(0, 5, 100, 7), (1, 5, 200, 8)]


def test_alert_texts(spark):
    df = spark.createDataFrame([(0x00,), (0x80,), (0x85,), (0x45,)], "f int")
    assert [r[0] for r in df.select(B.alert_flags("f")).collect()] == ["normal", "active(0)", "active(5)", "overflow(5)"]


def test_frame_machine(spark):
    m = frames.FrameMachine()
    assert m.feed(0, 0, 0) is None and m.feed(1, 1, 1) is None and m.feed(2, 0, 1) == (0, [0, 1])
    rows = [(1, i, c, 1) for i, c in enumerate([5, 6, 7, 0, 1, 2, 3, 0, 1])]
    h = spark.createDataFrame(rows, "sensor_id long, capture_seq long, pkt_cnt int, n_points int")
    a = {tuple(r) for r in frames.assemble_counted(h).collect()}
    assert a == {tuple(r) for r in frames.assemble_counted(h, exact=True).collect()} == {(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 4, 1), (1, 5, 1), (1, 6, 1)}


def test_numbered_frames(spark):
    h = spark.createDataFrame([(1, i, f) for i, f in enumerate([4, 4, 5, 5, 6])], "sensor_id long, capture_seq long, header_frame_id int")
    got = {(r["frame_id"], r["emitted_frame_id"], r["complete"]) for r in frames.assemble_numbered(h).collect()}
    assert got == {(4, 5, True), (5, 6, True), (6, None, False)}


def test_pack_and_pcd(spark, tmp_path):
    cols = {"x": np.array([1.0, 4.0]), "y": np.array([2.0, 5.0]), "z": np.array([3.0, 6.0]), "intensity": np.array([7, 255]), "cluster_id": np.array([2, 3])}
    assert pack.pack_array(cols) == struct.pack("<fffBfffB", 1, 2, 3, 7, 4, 5, 6, 255)
    assert pack.pack_array(cols, True) == struct.pack("<fffIBfffIB", 1, 2, 3, 2, 7, 4, 5, 6, 3, 255)
    assert pack.descriptors(pack.XYZCI) == [("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 8, 7, 1), ("cluster_id", 12, 6, 1), ("reflect", 16, 2, 1)]
    (tmp_path / "a.pcd").write_bytes(b"VERSION .7\nDATA binary\n" + pack.pack_array(cols))
    assert [(r["x"], r["z"]) for r in files.read_pcd(spark, str(tmp_path)).orderBy("pt_idx").collect()] == [(1.0, 3.0), (4.0, 6.0)]
    p = spark.createDataFrame([(1, 0, i, float(i), 0.0, 0.0, i, i) for i in range(3)], "sensor_id long, frame_id long, pt_idx int, x double, y double, z double, intensity int, cluster_id long")
    out = pack.with_cdr(pack.pack_points(p, True).withColumn("ts_ns", F.lit(1_500_000_000).cast("long")), True).first()
    assert out["n_points"] == 3 and bytes(out["data"]) in bytes(out["cdr"])


def test_test_sources(spark):
    assert bytes(streams.finite(spark, [b"12345678"], 4).first()["payload"]) == b"1234"
    assert streams.looping(streams.finite(spark, [b"a", b"b"]), 3).count() == 6


def test_ouster_payloads_are_worked_out_once(spark, capfd):
    """Short, foreign and missing packets give no pixels, and no filter repeats the payload's expression."""
    good = b"\1\0" + bytes(30) + bytes(10) + b"\1\0" + bytes(4)
    rows = spark.createDataFrame([(0, good), (1, good[:-1]), (2, b"\2" + good[1:]), (3, None), (4, good + b"more")], "capture_seq long, payload binary")
    found = decode.decode_ouster_pixels(rows, 1, 16, 1)
    found.explain(True)
    assert "conv(" not in capfd.readouterr().out
    raw = bytearray(good)
    raw[42:44] = b"\1\0"  # the column's status
    ok = spark.createDataFrame([(0, bytes(raw)), (1, bytes(raw[:-1])), (2, b"\2" + bytes(raw[1:])), (3, None), (4, bytes(raw) + b"more")], "capture_seq long, payload binary")
    assert sorted(r.capture_seq for r in decode.decode_ouster_pixels(ok, 1, 16, 1).collect()) == [0, 4]
