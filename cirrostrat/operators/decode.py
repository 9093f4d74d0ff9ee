"""Packet decoding: device packets to typed columns and points.

Headers are column expressions where the bytes are integers; blocks of packed records and 32-bit floats go through
Arrow and numpy. Decoders check length, sync and type, and put what fails into an ``error`` column instead of failing
the query. Filters that the raw bytes allow (zero radius, noisy points, bad columns) run inside the decoders, before
anything is turned into rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions import binary as B

# Packet layouts.
MSOP_SYNC, MSOP_SIZE, MSOP_BLOCKS = b"\x55\xaa\x5a\xa5", 1200, 96
DIFOP_SYNC, DIFOP_SIZE = b"\xa5\xff\x00\x5a\x11\x11\x55\x55", 256
COLUMN_HEADER = 12
NOISY = 2
_BLOCK = np.dtype([("time", ">u2"), ("radius", ">u2"), ("dir", ">i2", 3), ("intensity", "u1"), ("attribute", "u1")])


def msop_error(payload: str = "payload"):
    return F.when(F.octet_length(payload) < MSOP_SIZE, "short packet").when(~B.starts_with(payload, MSOP_SYNC), "bad sync")


def decode_msop_headers(packets: DataFrame) -> DataFrame:
    """``packets`` with pkt_cnt, return_mode, header_ns, temperature and error."""
    temperature = (B.u_be("payload", 31, 1) - 80).cast("tinyint")
    ns = B.u_be("payload", 10, 6) * 1_000_000_000 + B.u_be("payload", 16, 4) * 1000
    fields = {"pkt_cnt": B.u_be("payload", 4, 2).cast("int"), "return_mode": B.return_mode(B.u_be("payload", 8, 1)), "header_ns": ns, "temperature": temperature}
    error = msop_error()
    return packets.withColumns({k: F.when(error.isNull(), v) for k, v in fields.items()} | {"error": error})


def decode_msop_points(packets: DataFrame, keep: tuple[str, ...] = ("capture_seq",), include_noisy: bool = False) -> DataFrame:
    """Points of valid packets: the ``keep`` columns, block, x, y, z, range, intensity, attribute."""
    names = [*keep, "block", "x", "y", "z", "range", "intensity", "attribute"]
    source = packets.where(msop_error().isNull()).select(*keep, "payload")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(p[32 : 32 + 12 * MSOP_BLOCKS] for p in batch.column(len(keep)).to_pylist()), dtype=_BLOCK)
            ok = raw["radius"] != 0
            if not include_noisy:
                ok &= raw["attribute"] != NOISY
            at = np.flatnonzero(ok)
            b = raw[at]
            radius = b["radius"].astype(np.float32) * np.float32(0.005)
            xyz = b["dir"].astype(np.float32) / np.float32(32768) * radius[:, None]
            rows = pa.array(at // MSOP_BLOCKS)
            values = [pa.array((at % MSOP_BLOCKS).astype(np.int32)), *[pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)], pa.array(radius), pa.array(b["intensity"].astype(np.int16)), pa.array(b["attribute"].astype(np.int16))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(len(keep))], *values], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "payload")
    return source.mapInArrow(run, f"{kinds}, block int, x float, y float, z float, range float, intensity smallint, attribute smallint")


def count_points(payloads: list[bytes], include_noisy: bool = False) -> list[int]:
    """Points of each valid packet."""
    found: list[int] = []
    for start in range(0, len(payloads), 4096):  # their bytes are copied
        raw = np.frombuffer(b"".join(p[32 : 32 + 12 * MSOP_BLOCKS] for p in payloads[start : start + 4096]), dtype=_BLOCK).reshape(-1, MSOP_BLOCKS)
        found += ((raw["radius"] != 0) & (include_noisy | (raw["attribute"] != NOISY))).sum(axis=1).tolist()
    return found


def has_imu(payload: bytes) -> bool:
    """Whether a device packet is good and has six finite IMU values."""
    return len(payload) >= DIFOP_SIZE and payload[:8] == DIFOP_SYNC and bool(np.isfinite(np.frombuffer(payload[208:232], dtype=">f4")).all())


def decode_difop(packets: DataFrame) -> DataFrame:
    """``packets`` with device info and the six IMU values (all finite, or null for the row), and error."""
    error = F.when(F.octet_length("payload") < DIFOP_SIZE, "short packet").when(~B.starts_with("payload", DIFOP_SYNC), "bad sync")
    part = lambda at, n: F.substring("payload", at + 1, n)
    fields = {
        "version": B.version_text(part(16, 3)),
        "serial": B.serial_hex(part(20, 6)),
        "lidar_ip": B.dotted(part(44, 4)),
        "msop_port": B.u_be("payload", 62, 2).cast("int"),
        "difop_port": B.u_be("payload", 70, 2).cast("int"),
        "sync_mode": B.time_sync_mode(B.u_be("payload", 101, 1)),
        "sync_status": B.time_sync_status(B.u_be("payload", 102, 1)),
    }
    out = packets.withColumns({k: F.when(error.isNull(), v) for k, v in fields.items()} | {"error": error})
    names = ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")
    kinds = out.schema

    def run(batches):
        at = [f.name for f in kinds].index("payload")
        for batch in batches:
            rows = [np.frombuffer(p[208:232], dtype=">f4").astype(np.float32) if p and len(p) >= 232 else np.full(6, np.nan, dtype=np.float32) for p in batch.column(at).to_pylist()]
            imu = np.array(rows, dtype=np.float32).reshape(-1, 6)
            bad = ~np.isfinite(imu).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(imu[:, k]), mask=bad) for k in range(6)]], names=[f.name for f in kinds] + list(names))

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    decoded = out.mapInArrow(run, typed + ", " + ", ".join(f"{n} float" for n in names))
    return decoded.withColumns({n: F.when(F.col("error").isNull(), F.col(n)) for n in names})


def decode_ouster_headers(packets: DataFrame) -> DataFrame:
    """``packets`` with the header fields and error (little-endian)."""
    u = lambda at, n: B.u_le("payload", at, n)
    error = F.when(F.octet_length("payload") < 32, "short packet").when(u(0, 2) != 1, "not a lidar packet")
    limiting, shutdown = F.shiftright(u(19, 1), 4), F.shiftright(u(18, 1), 4)
    fields = {
        "header_frame_id": u(2, 2).cast("int"),
        "init_id": u(4, 3),
        "serial": u(7, 5),
        "alert": B.alert_flags(u(12, 1)),
        "shot_limiting": B.shot_limiting(limiting, u(17, 1)),
        "shutdown": B.shutdown_status(shutdown, u(16, 1)),
    }
    return packets.withColumns({k: F.when(error.isNull(), v) for k, v in fields.items()} | {"error": error})


def decode_ouster_pixels(packets: DataFrame, rows: int, cols: int, columns_per_packet: int = 16, keep: tuple[str, ...] = ("capture_seq",)) -> DataFrame:
    """Pixels of valid columns: the ``keep`` columns, col_in_packet, column_ts, row, col, depth, reflect."""
    names = [*keep, "col_in_packet", "column_ts", "row", "col", "depth", "reflect"]
    column = np.dtype([("ts", "<u8"), ("id", "<u2"), ("status", "u1"), ("pad", "u1"), ("px", np.dtype([("range", "<u2"), ("reflect", "u1"), ("nir", "u1")]), rows)])
    size = 32 + columns_per_packet * column.itemsize
    source = packets.select(*keep, "payload")

    def run(batches):
        for batch in batches:
            # checked here, as Spark would work the payload out again for every mention in a filter
            payloads = batch.column(len(keep)).to_pylist()
            good = [k for k, p in enumerate(payloads) if p is not None and len(p) >= size and p[:2] == b"\1\0"]
            if not good:
                continue
            batch = batch.take(pa.array(good))
            raw = np.frombuffer(b"".join(payloads[k][32:size] for k in good), dtype=column)
            at = np.flatnonzero((raw["status"] & 1 == 1) & (raw["id"] < cols))
            c, n = raw[at], len(at)
            packet = pa.array(np.repeat(at // columns_per_packet, rows))
            each = lambda v, t: pa.array(np.repeat(v.astype(t), rows))
            values = [
                each(at % columns_per_packet, np.int32), each(c["ts"], np.int64), pa.array(np.tile(np.arange(rows, dtype=np.int32), n)), each(c["id"], np.int32),
                pa.array((c["px"]["range"] & 0x7FFF).astype(np.int32).ravel()), pa.array(c["px"]["reflect"].astype(np.int16).ravel()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(packet) for k in range(len(keep))], *values], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "payload")
    return source.mapInArrow(run, f"{kinds}, col_in_packet int, column_ts long, row int, col int, depth int, reflect smallint")
