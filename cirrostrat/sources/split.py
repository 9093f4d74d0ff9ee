"""Captures cut into byte ranges, so that one long capture is read by many tasks.

Records of a capture have no marks between them, so a task that starts inside finds a record's beginning by chains: headers
that are plausible one after the other, each where the one before it ends. Chains are followed from all places of the
``LOOK_BACK`` bytes ahead of the range, and most lead to the true one: those from true records do, and those that begin
inside a record's own bytes meet it or break off. A task reads the records that begin in its range; where it ends, it looks for the next range's beginning as
that range's task does, and another answer than its own is an error and no result: ``split_bytes`` 0 then reads a file in
one task. So the tasks' records together are those of one task, or there are none.

A record's ``capture_seq`` is its place in the file (in units of 16 bytes, less than any record has), so no task needs to
know how many records came before.

``read_records(where=...)`` pushes filters on addresses, protocol, ports and ``capture_seq`` into the scan, which then builds
no rows that fail them and reads no ranges outside. Spark keeps what one query has pushed into a Python source with the
loaded table, and later queries of the same table would get it too; so only that condition, on a table of its own, is
pushed, and nothing that is put on top of it. ``port`` keeps datagrams that have a port on either side, and all fragments,
whose ports only reassembly tells.

Interfaces and sections that come after the first packet of a pcapng capture hold for all that follows, which other tasks
don't see: such a capture is an error unless it is read whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cirrostrat.sources.capture import _FIELDS, _RECORDS, _TYPES, BATCH, NG_MAGIC, _batch, _matching, _resolution, in_sequence, ipv4, reassembled, udp, write_pcap

SPLIT_BYTES = 128 << 20
LOOK_BACK = 1 << 20
#: Records that must follow where chains lead, and bytes that are read at a time.
CHAIN, CHUNK = 64, 4 << 20
#: Bytes that are read with a range behind its end, for its last record.
MARGIN = 64 << 10
#: Ranges from which on a task takes several, of at most ``SPLIT_BYTES`` together.
MANY = 256
#: Records are longer than 2 ** UNIT bytes, headers included.
UNIT = 4
_MOST = 1 << 24
#: Packets of an exported capture: some 130 MB of a counted sensor's.
FILE_PACKETS = 100_000
_SCHEMA = _RECORDS + ", src_port int, dst_port int"
_ALL_FIELDS, _ALL_TYPES = (*_FIELDS, "src_port", "dst_port"), (*_TYPES, pa.int32(), pa.int32())
_PUSHED = ("src", "dst", "proto", "src_port", "dst_port")


@dataclass(frozen=True)
class Layout:
    """What a capture's beginning tells of its records: byte order, ng or legacy, time units, where records begin."""

    order: str
    ng: bool
    unit: int
    ticks: tuple[int, ...]
    first: int


def layout(file) -> Layout | None:
    """Of an open file; None without a whole header."""
    start = file.read_at(24, 0)
    if len(start) < 24:
        return None
    if start[:4] != NG_MAGIC:
        order = "<" if start[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
        return Layout(order, False, 1 if start[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1000, (), 24)
    order, ticks, at = ("<" if start[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), [], 0
    while len(head := file.read_at(8, at)) == 8:
        kind, total = struct.unpack(order + "II", head)
        if total < 12 or kind in (2, 3, 6):
            break
        if kind == 1:
            ticks.append(_resolution(file.read_at(total, at)[8:-4], order))
        at += total
    return Layout(order, True, 0, tuple(ticks), at)


class _Ahead:
    """Bytes of a file from ``base`` on, at most ``most`` of them, read as far as they are asked for."""

    def __init__(self, file, size: int, base: int, most: int):
        self.file, self.base, self.end, self.data = file, base, max(0, min(most, size - base)), b""

    def holds(self, n: int) -> bool:
        if n > self.end:
            return False
        if n > len(self.data):
            have = len(self.data)
            self.data += self.file.read_at(min(self.end, max(n, have + 2 * MARGIN if have else n)) - have, self.base + have)
        return n <= len(self.data)


def _step(ahead: _Ahead, form: Layout, at: int) -> int:
    """Length of the record that may begin at a place, 0 if none can."""
    if not ahead.holds(at + (12 if form.ng else 16)):
        return 0
    if not form.ng:
        fraction, held, whole = struct.unpack_from(form.order + "4xIII", ahead.data, at)
        return held + 16 if fraction < _fractions(form) and 0 < held <= whole <= _MOST else 0
    kind, total = struct.unpack_from(form.order + "II", ahead.data, at)
    if not 12 <= total <= _MOST or total % 4 or not (kind < 256 or kind == 0x0A0D0D0A):
        return 0
    return total if not ahead.holds(at + total) or struct.unpack_from(form.order + "I", ahead.data, at + total - 4)[0] == total else 0


def _fractions(form: Layout) -> int:
    return 1_000_000_000 if form.unit == 1 else 1_000_000


def _steps(ahead: _Ahead, form: Layout, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``places`` where a record may begin, and the lengths of those records: ``_step`` for all of them. Numbers are
    looked at where they stand, and only those headers further that may be some."""
    ahead.holds(min(places + 16, ahead.end))
    found, lengths = [], []
    for k in range(1 if form.ng else 4):  # blocks of pcapng begin at multiples of four
        n = min((len(ahead.data) - k) // 4 - (2 if form.ng else 3), (places - k + 3) // 4)
        if n <= 0:
            continue
        v = np.frombuffer(ahead.data, form.order + "u4", n + 3 - form.ng, k)
        total = v[1 : n + 1] if form.ng else v[2 : n + 2]
        at = np.flatnonzero((total > 0) & (total <= _MOST))
        if form.ng:
            at = at[(total[at] >= 12) & (total[at] % 4 == 0) & ((v[at] < 256) | (v[at] == 0x0A0D0D0A))]
            ends = at * 4 + total[at]
            inside = ends <= ahead.end
            if inside.any() and ahead.holds(int(ends[inside].max())):
                words = np.frombuffer(ahead.data, form.order + "u4", len(ahead.data) // 4)
                inside[inside] = words[ends[inside] // 4 - 1] != total[at[inside]]
                at = at[~inside]
        else:
            at = at[(total[at] <= v[at + 3]) & (v[at + 3] <= _MOST) & (v[at + 1] < _fractions(form))]
        found.append(at * 4 + k)
        lengths.append(total[at].astype(np.int64) + (0 if form.ng else 16))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, length = np.concatenate(found), np.concatenate(lengths)
    order = np.argsort(at)
    return at[order], length[order]


def boundary(file, size: int, form: Layout, at: int, look_back: int = LOOK_BACK) -> int:
    """The beginning of the first record at ``at`` or after it: where most chains lead that begin in the ``look_back``
    bytes before it, as all that begin at true records do. Where none holds, the file is walked from its beginning."""
    base = at - look_back
    base += -base % 4 if form.ng else 0
    if form.first < base < at:
        here = at - base
        ahead = _Ahead(file, size, base, here + CHUNK)
        starts, lengths = _steps(ahead, form, here)
        lands: dict[int, int] = {}
        for start, to in zip(starts[::-1].tolist(), (starts + lengths)[::-1].tolist(), strict=True):
            lands[start] = to if to >= here else lands.get(to, -1)
        found, votes = np.unique(np.array([to for to in lands.values() if to >= 0], np.int64), return_counts=True)
        for land in found[np.argsort(-votes, kind="stable")].tolist():
            to, n = land, 0
            while n < CHAIN and (length := _step(ahead, form, to)):
                to, n = to + length, n + 1
            if n == CHAIN or base + to == size == base + ahead.end:
                return base + land
    return next(_walk(file, form, form.first, at), (size, b""))[0]


def _walk(file, form: Layout, at: int, low: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each whole record from ``at`` on that begins at ``low`` or after it; ``chunk`` bytes are read at a time."""
    data, base = b"", at
    head = struct.Struct(form.order + ("II" if form.ng else "8xI"))
    need = 12 if form.ng else 16
    while True:
        here = at - base
        if len(data) - here < need:
            data, base, here = file.read_at(chunk, at), at, 0
            if len(data) < need:
                return
        length = head.unpack_from(data, here)[1] if form.ng else head.unpack_from(data, here)[0] + 16
        if form.ng and length < 12:
            return
        if len(data) - here < length:
            data, base, here = file.read_at(max(chunk, length), at), at, 0
            if len(data) < length:
                return
        if at >= low:
            yield at, data[here : here + length]
        at += length


def _record(form: Layout, ticks: list[int], raw: bytes) -> tuple[int | None, bytes] | None:
    """(time in ns, link-layer bytes) of a record; None for blocks without a packet."""
    order = form.order
    if not form.ng:
        sec, frac, held = struct.unpack_from(order + "III", raw)
        return sec * 1_000_000_000 + frac * form.unit, raw[16 : 16 + held]
    kind = struct.unpack_from(order + "I", raw)[0]
    if kind == 6 and len(raw) >= 32:
        port, high, low, held = struct.unpack_from(order + "IIII", raw, 8)
        return ((high << 32) | low) * 1_000_000_000 // (ticks[port] if port < len(ticks) else 1_000_000), raw[28:-4][:held]
    if kind == 3 and len(raw) >= 16:
        return None, raw[12:-4][: struct.unpack_from(order + "I", raw, 8)[0]]
    return None


def read_range(file, path: str, start: int, end: int, look_back: int = LOOK_BACK, known: dict[int, int] | None = None) -> Iterator[tuple]:
    """(path, place, time, link-layer bytes) of the records that begin in [start, end). ``known`` keeps the beginning that was
    found behind the range for who reads on."""
    size, form = file.size(), layout(file)
    if form is None:
        return
    whole, ticks = start <= form.first and end >= size, list(form.ticks)
    at = known[start] if known and start in known else boundary(file, size, form, start, look_back)
    for at, raw in _walk(file, form, at, at, min(CHUNK, max(0, end - at) + MARGIN)):
        if at >= end:
            break
        kind = struct.unpack_from(form.order + "I", raw)[0] if form.ng else -1
        if kind in (1, 0x0A0D0D0A):
            if not whole:
                raise ValueError(f"{path}: an interface or section after the first packet, read it with split_bytes 0")
            if kind == 1:
                ticks.append(_resolution(raw[8:-4], form.order))
            else:
                ticks = []
                form = Layout("<" if raw[8:12] == b"\x4d\x3c\x2b\x1a" else ">", True, 0, (), form.first)
        elif (found := _record(form, ticks, raw)) is not None:
            yield (path, at >> UNIT, *found)
    else:
        return
    if end < size and at != (next_ := boundary(file, size, form, end, look_back)):
        raise ValueError(f"{path}: records begin at {at} and at {next_} behind byte {end}, read it with split_bytes 0")
    if known is not None and end < size:
        known.clear()
        known[end] = next_


def _surely_whole(link: bytes) -> bool:
    """Whether an untagged frame's IPv4 header, if it has one, is that of a whole datagram."""
    return link[12:14] == b"\x08\x00" and len(link) >= 22 and not (link[20] & 0x3F or link[21])


def _ports(proto: int, offset: int, more: bool, data: bytes) -> tuple[int | None, int | None]:
    return struct.unpack_from(">HH", data) if proto == 17 and offset == 0 and not more and len(data) >= 8 else (None, None)


@dataclass
class _Ranges(InputPartition):
    """Ranges (path, start, end) of a task, one read after another."""

    ranges: list[tuple[str, int, int]]


class CaptureSource(DataSource):
    """``spark.read.format("captures")`` with options path (file or glob), split_bytes, look_back, port, fragments (true: only
    fragments, false: only whole datagrams): IPv4 records."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split, self.look_back = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("look_back", LOOK_BACK))
        self.port = int(options["port"]) if options.get("port") else None
        self.fragments = options["fragments"] == "true" if options.get("fragments") else None
        self.pushed = options.get("pushdown") == "true"
        self.equal: dict[str, set] = {}
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        if not self.pushed:
            yield from filters
            return
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _PUSHED and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, wanted) & wanted
            elif name == "capture_seq" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "capture_seq" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, system in _matching(self.path):
            size = system.get_file_info(path).size
            step = self.split or max(size, 1)
            out += [(path, a, min(a + step, size)) for a in range(0, size, step) if (a + step) >> UNIT >= self.low and a >> UNIT < self.high]
        # many short ranges go several to a task, as starting one takes longer than reading some MB
        each = max(1, min(-(-len(out) // MANY), SPLIT_BYTES // self.split)) if self.split else 1
        return [_Ranges(out[i : i + each]) for i in range(0, len(out), each)] or [_Ranges([])]

    def _rows(self, path: str, start: int, end: int, file, known: dict[int, int]) -> Iterator[tuple]:
        wanted = [(_PUSHED.index(k), v) for k, v in self.equal.items()]
        for _, seq, ts, link in read_range(file, path, start, end, self.look_back, known):
            if not self.low <= seq < self.high or (self.fragments and _surely_whole(link)) or (ip := ipv4(link)) is None:
                continue
            src, dst, proto, _, offset, more, data = ip
            if self.fragments is not None and self.fragments != (offset > 0 or more):
                continue
            ports = _ports(proto, offset, more, data)
            if self.port is not None and (proto != 17 or (ports[0] is not None and self.port not in ports)):
                continue
            if wanted:
                held = (src, dst, proto, *ports)
                if any(held[k] not in v for k, v in wanted):
                    continue
            yield (path, seq, ts, *ip, None, *ports)

    def read(self, partition: _Ranges):
        system = pa_fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pa_fs.LocalFileSystem()
        for path, ranges in groupby(partition.ranges, key=lambda r: r[0]):
            with system.open_input_file(path) as file:
                known: dict[int, int] = {}
                rows = chain.from_iterable(self._rows(*r, file, known) for r in ranges)
                while part := list(islice(rows, BATCH)):
                    yield _batch(part, _ALL_TYPES, _ALL_FIELDS)


def in_files(packets: DataFrame, file_packets: int = FILE_PACKETS) -> DataFrame:
    """``packets`` (or what they are made from, which moves faster) cut by capture_seq into sorted partitions of about
    ``file_packets``, so that no task of ``export`` grows with them."""
    return packets.repartitionByRange(max(4, -(-packets.count() // file_packets)), "capture_seq").sortWithinPartitions("capture_seq")


#: What stands before a payload in an exported capture: the record's, Ethernet's, IPv4's and UDP's headers.
_HEADERS = np.dtype([
    ("sec", "<u4"), ("usec", "<u4"), ("held", "<u4"), ("length", "<u4"), ("macs", "u1", 12), ("kind", ">u2"), ("version", "u1"), ("tos", "u1"), ("total", ">u2"),
    ("ident", ">u2"), ("flags", ">u2"), ("ttl", "u1"), ("proto", "u1"), ("sum", ">u2"), ("src", "V4"), ("dst", "V4"), ("src_port", ">u2"), ("dst_port", ">u2"), ("size", ">u2"), ("check", ">u2"),
])


def udp_records(src_ip: pa.Array, dst_ip: pa.Array, src_port: pa.Array, dst_port: pa.Array, ts_ns: pa.Array, payload: pa.Array) -> bytes:
    """The records of a legacy capture, one a datagram: as ``write_pcap`` writes what ``ethernet_udp`` makes."""
    payloads = payload.to_pylist()
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    sec, ns = np.divmod(ts_ns.to_numpy(zero_copy_only=False), 1_000_000_000)
    out = np.zeros(len(payloads), _HEADERS)
    numbers = {"sec": sec, "usec": ns // 1000, "held": size + 42, "length": size + 42, "total": size + 28, "size": size + 8, "src_port": src_port, "dst_port": dst_port}
    for name, values in numbers.items():
        v = values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values
        if len(v) and not (v.min() >= 0 and v.max() < 1 << 8 * out[name].itemsize):
            raise ValueError(f"{name}: a number that has no place in a capture")
        out[name] = v
    for name, fixed in (("kind", 0x0800), ("version", 0x45), ("ttl", 64), ("proto", 17)):
        out[name] = fixed
    for name, address in (("src", src_ip), ("dst", dst_ip)):
        known = address.dictionary_encode()
        each = np.array([struct.pack("4s", bytes(map(int, a.split(".")))) for a in known.dictionary.to_pylist()], "V4")
        out[name] = each[known.indices.to_numpy(zero_copy_only=False)]
    heads, n = out.tobytes(), _HEADERS.itemsize
    return b"".join(x for k, p in enumerate(payloads) for x in (heads[k * n : k * n + n], p))


def export(packets: DataFrame, folder: str) -> int:
    """Write UDP packets (src_ip, dst_ip, src_port, dst_port, ts_ns, capture_seq, payload) as legacy captures into ``folder``,
    one a partition in the order of capture_seq, and give their number. A task that is tried again writes the same file; file
    names are in the order of the partitions. Null payloads and addresses are left out."""
    names = ("src_ip", "dst_ip", "src_port", "dst_port", "ts_ns", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa_fs.LocalFileSystem(), folder)
        at, out = f"part-{TaskContext.get().partitionId():06d}.pcap", None
        part = f"{root}/.{at}.{uuid.uuid4().hex}"
        for batch in (b.slice(at_row, BATCH) for b in batches for at_row in range(0, b.num_rows, BATCH)):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(part)
                out.write(write_pcap([]))
            out.write(udp_records(*batch.columns))
        if out is not None:
            out.close()
            system.move(part, f"{root}/{at}")
            yield pa.RecordBatch.from_arrays([pa.array([at])], names=["file"])

    known = packets.where("src_ip is not null and dst_ip is not null and payload is not null and ts_ns is not null")
    return known.sortWithinPartitions("capture_seq").select(*names).mapInArrow(run, "file string").count()


def read_records(spark: SparkSession, path: str, where: str | None = None, port: int | None = None, split_bytes: int = SPLIT_BYTES, look_back: int = LOOK_BACK, fragments: bool | None = None) -> DataFrame:
    """IPv4 records of the captures that ``path`` names (a file or glob of a file system that Arrow knows); ``fragments``: only
    those, or only whole datagrams."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # sources that could take filters aren't read without it
    options = {"path": path, "split_bytes": str(split_bytes), "look_back": str(look_back)} | ({"port": str(port)} if port is not None else {})
    options |= {"fragments": str(fragments).lower()} if fragments is not None else {}
    if where is None:
        return spark.read.format("captures").options(**options).load()
    found = spark.read.format("captures").options(**options, pushdown="true").load().where(where)
    return found.observe(f"captures-{uuid.uuid4().hex}", F.count("*").alias("records"))  # filters don't go below it


def read_split_packets(spark: SparkSession, path: str, port: int | None = None, target: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """UDP packets of captures of any length, by ranges of ``split_bytes`` (0: a file a task); as ``capture.read_packets``
    gives them, but for the numbers in ``capture_seq``. ``target``: only those from this address."""
    where = "proto = 17" + (f" and src = '{target}'" if target else "")
    paths = [p for p, _ in _matching(path)]
    # whole datagrams and fragments take different ways, so each is read by itself and no task gives the other's rows to Spark
    rows = lambda fragments: in_sequence(read_records(spark, path, where, port, split_bytes, fragments=fragments).drop("src_port", "dst_port"), paths)
    return udp(reassembled(rows(False), rows(True)), port)
