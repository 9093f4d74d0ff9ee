"""Captures read record by record, and several of them as one recording."""

import io
import struct

from cirrostrat.config import Settings
from cirrostrat.plans import clouds
from cirrostrat.sources import capture
from tests.test_engine_cases import msop


def blocks(order, links):
    block = lambda kind, body: struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    return section + block(1, struct.pack(order + "HHI", 1, 0, 0)) + b"".join(block(6, struct.pack(order + "IIIII", 0, 0, n, len(x), len(x)) + x + b"\0" * (-len(x) % 4)) for n, x in enumerate(links))


def test_files_and_bytes_alike():
    links = [capture.ethernet_udp(bytes([k]) * (k + 1))[0] for k in range(5)]
    legacy = capture.write_pcap([(n * 1000, x) for n, x in enumerate(links)])
    for data in (legacy, blocks("<", links), blocks(">", links), blocks("<", links[:2]) + blocks(">", links[2:])):
        for cut in (len(data), len(data) - 3, 30, 23, 3, 0):
            part = data[:cut]
            assert list(capture.records(part)) == list(capture.records(io.BytesIO(part)))
        assert [x for _, x in capture.records(data)] == links
        assert [x for _, x in capture.records(data[:-3])] == links[:-1]


def test_one_recording_in_two_captures(spark, tmp_path):
    """A frame goes on from one capture to the next; both readers give the same packets in the same order."""
    counts = [3, 4, 0, 1, 2, 3, 0, 1]
    links = [capture.ethernet_udp(msop(c, 5 + n, [300 + n]), src="10.0.0.4")[0] for n, c in enumerate(counts)]
    for name, part in (("a 1.pcap", range(4)), ("b 2.pcap", range(4, 8))):
        (tmp_path / name).write_bytes(capture.write_pcap([(n * 1_000_000_000, links[n]) for n in part]))
    whole, long = capture.read_packets(spark, str(tmp_path)), capture.read_long_packets(spark, str(tmp_path / "*.pcap"))
    rows = [[(r["capture_seq"], r["ts_ns"], bytes(r["payload"])) for r in df.orderBy("capture_seq").collect()] for df in (whole, long)]
    assert rows[0] == rows[1] and [t for _, t, _ in rows[0]] == [n * 1_000_000_000 for n in range(8)]
    points = clouds.counted_points(whole, Settings())
    # the packets that show a boundary (counts 0) are in no frame: 3, 4 | 1, 2, 3
    assert [(r["frame_id"], r["pt_idx"], r["ts_ns"] // 10**9) for r in points.orderBy("frame_id", "pt_idx").collect()] == [(0, 0, 0), (0, 1, 1), (1, 0, 3), (1, 1, 4), (1, 2, 5)]
