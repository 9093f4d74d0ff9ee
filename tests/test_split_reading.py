"""What reading captures by ranges takes, and the exported records."""

import random

import pyarrow as pa
import pytest

from cirrostrat.sources import capture, split
from tests.test_split_captures import links, ng, read


class Counted:
    """A file that counts the bytes that are read."""

    def __init__(self, data):
        self.file, self.n = pa.BufferReader(data), 0

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        found = self.file.read_at(n, at)
        self.n += len(found)
        return found


def test_a_short_range_reads_no_more_than_it_needs():
    """Twice what is looked back on and the range itself; not megabytes behind it."""
    data = capture.write_pcap([(k * 1_000, capture.ethernet_udp(bytes(1_200))[0]) for k in range(10_000)])
    file, at = Counted(data), len(data) // 2
    rows = list(split.read_range(file, "p", at, at + 100_000, 200_000))
    assert [r[2:] for r in rows] == list(capture.records(data))[rows[0][2] // 1_000 :][: len(rows)] and len(rows) in (79, 80)
    assert file.n < 2 * 2 * 200_000 + 100_000 + 4 * split.MARGIN


@pytest.mark.parametrize("form", [capture.write_pcap, ng])
def test_ranges_one_after_another(form, monkeypatch):
    """A task that reads on from one range to the next takes over the beginning that it has found."""
    monkeypatch.setattr(split, "CHAIN", 6)
    data = form(links(200))
    file, known, found, asked = pa.BufferReader(data), {}, [], []
    boundary = split.boundary
    monkeypatch.setattr(split, "boundary", lambda *a: asked.append(a[3]) or boundary(*a))
    for at in range(0, len(data), 900):
        found += [r[2:] for r in split.read_range(file, "p", at, min(at + 900, len(data)), 1_000, known)]
    assert found == list(capture.records(data)) == read(data, [len(data) // 2], 1_000)
    assert len(set(asked)) >= len(asked) - 3  # but for the last boundary of the file and read()'s own


def test_many_ranges_go_to_fewer_tasks(spark, tmp_path, monkeypatch):
    for name, seed in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.pcap").write_bytes(capture.write_pcap(links(300, seed)))
    path = f"{tmp_path}/*.pcap"
    whole = sorted(split.read_records(spark, path, split_bytes=0).collect(), key=str)
    ranges = -(-(tmp_path / "a.pcap").stat().st_size // 100)
    for many in (20, 10_000):
        monkeypatch.setattr(split, "MANY", many)
        tasks = split._RangeReader({"path": path, "split_bytes": "100"}).partitions()
        assert len({r for t in tasks for r in t.ranges}) == sum(len(t.ranges) for t in tasks) >= 2 * ranges - 200
        assert len(tasks) <= many if many == 20 else len(tasks) > 300
    rows = split.read_records(spark, path, split_bytes=100)
    assert sorted(rows.collect(), key=str) == whole and rows.rdd.getNumPartitions() <= 256


def test_fragments_and_whole_datagrams_apart(spark, tmp_path):
    """Each is read by itself: no scan gives rows that its branch of reassembly throws away."""
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap(links(150)))
    some = lambda fragments: split.read_records(spark, str(tmp_path / "a.pcap"), None, 6699, 2_000, fragments=fragments).collect()
    every, whole, parts = some(None), some(False), some(True)
    assert sorted(whole + parts, key=str) == sorted(every, key=str) and whole and parts
    assert all(r.offset > 0 or r.more for r in parts) and not any(r.offset > 0 or r.more for r in whole)


def test_exported_records_are_those_of_single_datagrams():
    rng = random.Random(3)
    rows = [(f"10.0.{rng.randrange(3)}.{k}", "10.0.1.1", rng.randrange(1 << 16), k, rng.randrange(1 << 61), rng.randbytes(rng.choice([0, 1, 7, 1_200, 65_507]))) for k in range(50)]
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = lambda rows: [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    assert split.udp_records(*columns(rows)) == capture.write_pcap([(ts, x) for a, b, p, q, ts, d in rows for x in capture.ethernet_udp(d, a, b, p, q)])[24:]
    for wrong in (("10.0.0.1", "10.0.0.2", 70_000, 1, 5, b"x"), ("10.0.0.1", "10.0.0.2", 1, 1, -5, b"x"), ("10.0.0.1", "10.0.0.2", 1, None, 5, b"x"), ("10.0.0.1", "10.0.0.2", 1, 1, 5, bytes(65_508))):
        with pytest.raises(ValueError, match="no place"):
            split.udp_records(*columns([wrong]))
    assert split.udp_records(*[pa.array([], t) for t in types]) == b""
