"""Capture files: legacy pcap and pcapng records, IPv4 reassembly, UDP payloads.

``read_packets`` scans files with Spark's binary reader (any Hadoop file system) and cuts them into link-layer records in
Arrow tasks. Unfragmented UDP packets never move; only fragments are grouped, by (capture, src, dst, protocol, ident).
A gap or a missing first or last fragment sends the datagram to the dead letters (column ``error``), and reassembled
packets take the capture position of their first fragment. The captures of a folder or glob are one recording, in the
order of their paths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKETS = "capture string, capture_seq long, ts_ns long, src_ip string, dst_ip string, src_port int, dst_port int, payload binary, error string"
_RECORDS = "capture string, capture_seq long, ts_ns long, src string, dst string, proto int, ident int, offset int, more boolean, data binary, error string"
NG_MAGIC = b"\x0a\x0d\x0d\x0a"
#: Time after which a fragment with a known identification belongs to another datagram.
PAUSE_NS = 15_000_000_000
#: Records of an Arrow batch.
BATCH = 4096
#: Place of a capture's number in capture_seq: a capture has fewer records.
CAPTURE_SHIFT = 40
#: Captures whose names and numbers are broadcast to the records at most.
MOST_NAMES = 100_000


def is_pcapng(data: bytes) -> bool:
    return bytes(data[:4]) == NG_MAGIC


def records(data) -> Iterator[tuple[int | None, bytes]]:
    """(time in ns, link-layer bytes) of each record of a capture: its bytes, or a file that is read record by record. An
    incomplete tail ends the capture silently."""
    file = data if hasattr(data, "read") else pa.BufferReader(data)
    start = file.read(24)
    yield from _ng(file, start) if is_pcapng(start) else _legacy(file, start)


def _legacy(file, start: bytes) -> Iterator[tuple[int | None, bytes]]:
    if len(start) < 24:
        return
    magic = start[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1000
    head = struct.Struct(order + "IIII")
    while len(raw := file.read(16)) == 16:
        sec, frac, captured, _ = head.unpack(raw)
        if len(link := file.read(captured)) < captured:
            return
        yield sec * 1_000_000_000 + frac * unit, link


def _ng(file, start: bytes) -> Iterator[tuple[int | None, bytes]]:
    ahead, order, ticks = start, "<", []

    def take(n: int) -> bytes:
        nonlocal ahead
        if len(ahead) < n:
            ahead += file.read(n - len(ahead))
        out, ahead = ahead[:n], ahead[n:]
        return out

    while len(head := take(12)) == 12:
        if head[:4] == NG_MAGIC:
            order, ticks = ("<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, total = struct.unpack_from(order + "II", head)
        if total < 12 or len(rest := take(total - 12)) < total - 12:
            return
        body = (head[8:] + rest)[:-4]
        if kind == 1:
            ticks.append(_resolution(body, order))
        elif kind == 6 and len(body) >= 20:
            port, high, low, captured = struct.unpack_from(order + "IIII", body)
            tick = ticks[port] if port < len(ticks) else 1_000_000
            yield ((high << 32) | low) * 1_000_000_000 // tick, body[20 : 20 + captured]
        elif kind == 3 and len(body) >= 4:
            yield None, body[4 : 4 + struct.unpack_from(order + "I", body)[0]]


def _resolution(body: bytes, order: str) -> int:
    """Ticks a second of an interface (option 9)."""
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = body[at + 4]
            return 1 << (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + -(-size // 4) * 4
    return 1_000_000


def ipv4(link: bytes) -> tuple | None:
    """(src, dst, proto, ident, offset, more, data) of an Ethernet frame with IPv4, else None."""
    at = 14
    if len(link) < 34:
        return None
    kind = link[12:14]
    while kind in (b"\x81\x00", b"\x88\xa8") and len(link) >= at + 4:
        kind, at = link[at + 2 : at + 4], at + 4
    if kind != b"\x08\x00" or len(link) < at + 20 or link[at] >> 4 != 4:
        return None
    size = (link[at] & 15) * 4
    total, ident, flags = struct.unpack_from(">HHH", link, at + 2)
    ip = lambda k: ".".join(map(str, link[at + k : at + k + 4]))
    return ip(12), ip(16), link[at + 9], ident, (flags & 0x1FFF) * 8, bool(flags & 0x2000), link[at + size : at + max(size, total)]


_FIELDS = ("capture", "capture_seq", "ts_ns", "src", "dst", "proto", "ident", "offset", "more", "data", "error")
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string())


def _batch(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _ip_rows(path: str, found: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple]:
    """IPv4 records; anything else is dropped, as the sensors send nothing else."""
    for seq, (ts, link) in enumerate(found):
        ip = ipv4(link)
        if ip is not None:
            yield (path, seq, ts, *ip, None)


def _cut(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = _ip_rows(path, records(content.as_buffer()))
            while part := list(islice(rows, BATCH)):
                yield _batch(part, _TYPES, _FIELDS)


def cut(files: DataFrame) -> DataFrame:
    """IPv4 records of capture files (path, content)."""
    return files.select("path", "content").mapInArrow(_cut, _RECORDS)


def reassembled(rows: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """IPv4 records with fragments joined: sorted by offset, from 0 to a last one without a gap, else an error. ``fragments``
    has the fragments where ``rows`` doesn't.

    Identifications have 16 bits and come again: a pause of ``PAUSE_NS`` among the fragments of one, or another first
    fragment, starts the next datagram."""
    whole = rows.where("offset = 0 and not more").select("capture", "capture_seq", "ts_ns", "src", "dst", "proto", "data", "error")
    names = ("capture", "src", "dst", "proto", "ident")
    seen = Window.partitionBy(*names).orderBy("capture_seq")
    paused = F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(seen) > PAUSE_NS, F.lit(False))
    parts = (rows if fragments is None else fragments).where("offset > 0 or more").withColumn("pause", paused)
    parts = parts.withColumn("session", F.sum(F.col("pause").cast("int")).over(seen))
    own = Window.partitionBy(*names, "session").orderBy("capture_seq")
    first = F.when(F.col("offset") == 0, F.xxhash64("data"))
    again = F.coalesce(first != F.last(first, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    parts = parts.withColumn("again", again).withColumn("turn", F.sum(F.col("again").cast("int")).over(own))
    parts = (
        parts.groupBy(*names, "session", "turn")
        .agg(F.min("capture_seq").alias("capture_seq"), F.min_by("ts_ns", "capture_seq").alias("ts_ns"), F.array_sort(F.collect_list(F.struct("offset", "capture_seq", "more", "data"))).alias("f"))
    )
    start = F.struct(F.lit(b"").alias("data"), F.lit(True).alias("more"), F.lit(True).alias("good"))

    def step(acc, f):
        fits = acc["good"] & (f["offset"] == F.octet_length(acc["data"]))
        again = f["offset"] < F.octet_length(acc["data"])  # a fragment seen before
        return F.struct(F.when(fits, F.concat(acc["data"], f["data"])).otherwise(acc["data"]).alias("data"), F.when(fits, f["more"]).otherwise(acc["more"]).alias("more"), (acc["good"] & (fits | again)).alias("good"))

    joined = parts.withColumn("r", F.aggregate("f", start, step))
    error = F.when(~F.col("r.good") | F.col("r.more"), F.lit("fragments missing"))
    return whole.unionByName(joined.select("capture", "capture_seq", "ts_ns", "src", "dst", "proto", F.col("r.data").alias("data"), error.alias("error")))


def udp(rows: DataFrame, port: int | None = None) -> DataFrame:
    """UDP payloads of whole IPv4 records; ``port`` matches either side; empty payloads are dropped."""
    from cirrostrat.functions.binary import u_be

    found = rows.where("proto = 17").withColumns({"src_port": u_be("data", 0, 2).cast("int"), "dst_port": u_be("data", 2, 2).cast("int"), "size": u_be("data", 4, 2)})
    if port is not None:
        found = found.where((F.col("src_port") == port) | (F.col("dst_port") == port))
    payload = F.expr("substring(data, 9, cast(greatest(size - 8, 0) as int))")
    out = found.select("capture", "capture_seq", "ts_ns", F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), "src_port", "dst_port", payload.alias("payload"), "error")
    return out.where(F.col("error").isNotNull() | (F.octet_length("payload") > 0))


def read_packets(spark: SparkSession, path: str, port: int | None = None) -> DataFrame:
    """UDP packets of the captures under ``path`` (file, folder or glob of any Hadoop file system), each at most 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return udp(reassembled(in_sequence(cut(files), [r["path"] for r in files.select("path").toLocalIterator()])), port)


def read_long_packets(spark: SparkSession, path: str, port: int | None = None) -> DataFrame:
    """``read_packets`` for captures of any length: the ``pcap`` source reads a file record by record, in one task with
    a batch of memory. ``path`` is a file or glob of a file system that Arrow knows (a shared folder, hdfs, s3, gs)."""
    spark.dataSource.register(PcapDataSource)
    rows = spark.read.format("pcap").option("path", path).option("layer", "ip").load()
    return udp(reassembled(in_sequence(rows, [p for p, _ in _matching(path)])), port)


def in_sequence(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Records of several captures as one recording, in the order of their paths: the number of the capture goes above
    the record's own in capture_seq, so that frames may go on from one capture to the next."""
    if len(paths) < 2:
        return rows
    names = rows.sparkSession.createDataFrame(list(enumerate(sorted(paths))), "__n long, __path string")
    # a row per capture file, which the driver lists anyway to plan the scan
    out = rows.join(F.broadcast(names) if len(paths) <= MOST_NAMES else names, F.col("capture") == F.col("__path"))
    return out.withColumn("capture_seq", F.shiftleft("__n", CAPTURE_SHIFT) + F.col("capture_seq")).select(*rows.columns)


class PcapDataSource(DataSource):
    """``spark.read.format("pcap").option("path", ...)``: records of captures, one partition a file, read record by record.
    Option ``layer``: ``link`` (default: link-layer bytes) or ``ip`` (the columns that ``cut`` gives)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return _RECORDS if self.options.get("layer") == "ip" else "capture string, capture_seq long, ts_ns long, link binary"

    def reader(self, schema) -> DataSourceReader:
        return _PcapReader(self.options["path"], self.options.get("layer") == "ip")


def _matching(path: str) -> list[tuple[str, object]]:
    """(path, file system) of the files that ``path`` names, with a glob in its last part only."""
    system, at = (pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path))
    folder, _, last = at.rpartition("/")
    if not set("*?[") & set(last):
        return [(at, system)]
    found = system.get_file_info(pa_fs.FileSelector(folder or "."))
    return sorted(((f.path, system) for f in found if f.is_file and fnmatch(f.base_name, last)), key=lambda x: x[0])


class _PcapReader(DataSourceReader):
    def __init__(self, path: str, ip: bool):
        self.path, self.ip = path, ip

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p, _ in _matching(self.path)]

    def read(self, partition: InputPartition):
        system = pa_fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pa_fs.LocalFileSystem()
        with system.open_input_stream(partition.value, buffer_size=1 << 20) as file:
            found = records(file)
            rows = _ip_rows(partition.value, found) if self.ip else ((partition.value, seq, ts, link) for seq, (ts, link) in enumerate(found))
            types, names = (_TYPES, _FIELDS) if self.ip else ((pa.string(), pa.int64(), pa.int64(), pa.binary()), ("capture", "capture_seq", "ts_ns", "link"))
            while part := list(islice(rows, BATCH)):
                yield _batch(part, types, names)


def write_pcap(packets: list[tuple[int, bytes]]) -> bytes:
    """A legacy capture of (time in ns, link-layer bytes)."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for ts, link in packets:
        out.append(struct.pack("<IIII", ts // 1_000_000_000, ts % 1_000_000_000 // 1000, len(link), len(link)) + link)
    return b"".join(out)


def ethernet_udp(payload: bytes, src: str = "10.0.0.2", dst: str = "10.0.0.1", src_port: int = 6699, dst_port: int = 6699, ident: int = 0, mtu: int | None = None) -> list[bytes]:
    """Ethernet frames of one UDP datagram, in fragments of at most ``mtu`` bytes of IP payload."""
    body = struct.pack(">HHHH", src_port, dst_port, 8 + len(payload), 0) + payload
    step, out = (mtu // 8 * 8 if mtu else max(8, len(body))), []
    for at in range(0, len(body), step):
        part = body[at : at + step]
        flags = at // 8 | (0x2000 if at + step < len(body) else 0)
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(part), ident, flags, 64, 17, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
        out.append(b"\0" * 12 + b"\x08\x00" + ip + part)
    return out
