"""Captures read by byte ranges against reading them whole."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrostrat.sources import capture, split


def links(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        port = rng.choice([6699, 7788, 53])
        out += capture.ethernet_udp(rng.randbytes(rng.randrange(1, 90)), src=f"10.0.0.{rng.randrange(3)}", src_port=port, dst_port=rng.choice([port, 9000]), ident=k, mtu=rng.choice([None, None, 40]))
    return [(1_000_000_000 * k + 1_000 * k, x) for k, x in enumerate(out)]


def ng(packets):
    """A pcapng capture of one section and one interface, with a few simple packets."""
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    padded = lambda b: b + bytes(-len(b) % 4)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for k, (ts, link) in enumerate(packets):
        if k % 7 == 3:
            out += block(3, struct.pack("<I", len(link)) + padded(link))
        else:
            out += block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(link), len(link)) + padded(link))
    return out


def read(data, cuts, look_back):
    file, ends = pa.BufferReader(data), [0, *cuts, len(data)]
    return [r[2:] for a, b in zip(ends, ends[1:], strict=False) for r in split.read_range(file, "p", a, b, look_back)]


@pytest.mark.parametrize("form", ["legacy", "ng", "nanoseconds"])
def test_every_cut_gives_the_records_of_one_task(form, monkeypatch):
    monkeypatch.setattr(split, "CHAIN", 6)
    packets = links(60)
    data = ng(packets) if form == "ng" else capture.write_pcap(packets)
    if form == "nanoseconds":
        data = b"\x4d\x3c\xb2\xa1" + data[4:]
    whole = list(capture.records(data))
    assert len(whole) == len(packets)
    for at in range(1, len(data)):
        assert read(data, [at], 700) == whole, at
    for step in (37, 200, 1_000):
        assert read(data, list(range(step, len(data), step)), 1_000) == whole
    for at in range(1, len(data), 13):
        assert read(data, [at], 0) == whole


def test_cut_last_record_and_small_files(monkeypatch):
    monkeypatch.setattr(split, "CHAIN", 6)
    data = capture.write_pcap(links(20))
    for short in (data[:-5], data[: len(data) // 2 + 3], data[:30], data[:24], data[:10], b""):
        whole = list(capture.records(short))
        for at in range(1, max(2, len(short)), 11):
            assert read(short, [at], 700) == whole


def test_captures_within_captures(monkeypatch):
    """Payloads that are whole captures themselves: a chain inside them is left for the true one."""
    monkeypatch.setattr(split, "CHAIN", 4)
    inner = capture.write_pcap([(k, bytes(30)) for k in range(12)])
    packets = [(k * 1_000, capture.ethernet_udp(inner[24:] if k % 3 else b"x" * k)[0]) for k in range(1, 40)]
    data = capture.write_pcap(packets)
    whole = list(capture.records(data))
    for at in range(1, len(data), 97):
        assert read(data, [at], 5_000) == whole
    for at in range(1, len(data), 7):  # with little to look back on: the right records or an error, never others
        try:
            assert read(data, [at], 60) == whole
        except ValueError as e:
            assert "split_bytes 0" in str(e)  # noqa: PT017


def test_later_interfaces_need_one_task():
    data = ng(links(30))
    data += ng(links(5, 2))
    assert read(data, [], 100) == list(capture.records(data))
    with pytest.raises(ValueError, match="split_bytes 0"):
        read(data, [len(data) // 3], 100)


def test_packets_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap(links(80)))
    (tmp_path / "b.pcap").write_bytes(ng(links(80, 2)))
    path = f"{tmp_path}/*.pcap"
    columns = ["ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "payload", "error"]
    for port in (None, 6699):
        want = [tuple(r) for r in capture.read_packets(spark, str(tmp_path), port).orderBy("capture_seq").select(columns).collect()]
        found = split.read_split_packets(spark, path, port, split_bytes=700)
        assert [tuple(r) for r in found.orderBy("capture_seq").select(columns).collect()] == want
    assert split.read_records(spark, path, split_bytes=700).rdd.getNumPartitions() > 10


def test_filters_are_pushed(spark, tmp_path, capsys):
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap(links(200)))
    read = lambda where=None: split.read_records(spark, str(tmp_path / "a.pcap"), where, split_bytes=2_000)
    rows = read()
    every = rows.collect()
    found = read("dst_port = 9000 and src = '10.0.0.1'")
    found.explain("formatted")
    assert "PushedFilters: [EqualTo(dst_port,9000), EqualTo(src,10.0.0.1)]" in capsys.readouterr().out
    wanted = [r for r in every if r.dst_port == 9000 and r.src == "10.0.0.1"]
    assert sorted(found.collect()) == sorted(wanted) and wanted
    middle = sorted(r.capture_seq for r in every)[100]
    late = read(f"capture_seq >= {middle}")
    assert late.count() == sum(r.capture_seq >= middle for r in every) and late.rdd.getNumPartitions() < rows.rdd.getNumPartitions()
    assert read("src_port is null").count() == sum(r.src_port is None for r in every)
    assert split.read_split_packets(spark, str(tmp_path / "a.pcap"), 6699, "10.0.0.2", 2_000).select("src_ip").distinct().collect() == [("10.0.0.2",)]


def test_a_table_gives_the_same_rows_after_any_query_on_it(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap(links(100)))
    path = str(tmp_path / "a.pcap")
    for rows in (split.read_records(spark, path, split_bytes=2_000), split.read_records(spark, path, "proto = 17", split_bytes=2_000)):
        n, m = rows.count(), rows.where("dst_port = 9000").count()
        assert n == rows.count() > m > 0
        a, b = rows.where("dst_port = 9000").select("capture_seq"), rows.where("src_port = 53").select("capture_seq")
        both = a.join(b, "capture_seq").count()
        assert both == rows.where("dst_port = 9000 and src_port = 53").count() > 0


def test_exported_files_grow_in_number_only(spark):
    packets = spark.range(1_000).select(F.col("id").alias("capture_seq"))
    for most, least in ((1_000, 4), (50, 20)):
        cut = split.in_files(packets, most)
        held = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(held) == 1_000 and len(held) >= least * 0.7 and max(held) <= 2 * 1_000 / least
