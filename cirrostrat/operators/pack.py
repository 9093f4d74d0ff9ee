"""Packed clouds: binary point records, messages and their CDR bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.functions.binary import le_bytes, ros_time
from cirrostrat.operators import groups

# Record layouts and field type codes of the message format.
XYZI = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflect", "u1")])
XYZCI = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("cluster_id", "<u4"), ("reflect", "u1")])
TYPE_CODES = {"int8": 1, "uint8": 2, "int16": 3, "uint16": 4, "int32": 5, "uint32": 6, "float32": 7, "float64": 8}
#: Points that are read back at a time, or those of one cloud.
UNPACKED = 100_000
FIELDS = "array<struct<name:string,offset:int,datatype:tinyint,count:int>>"


def descriptors(layout: np.dtype) -> list[tuple[str, int, int, int]]:
    return [(n, layout.fields[n][1], TYPE_CODES[layout.fields[n][0].name], 1) for n in layout.names]


def _fields_column(layout: np.dtype):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("offset"), F.lit(t).cast("tinyint").alias("datatype"), F.lit(c).alias("count")) for n, o, t, c in descriptors(layout)]).cast(FIELDS)


def pack_array(columns: dict[str, np.ndarray], clustered: bool = False) -> bytes:
    """Little-endian records of x, y, z, intensity (and cluster_id)."""
    out = np.empty(len(columns["x"]), dtype=XYZCI if clustered else XYZI)
    for c in "xyz":
        out[c] = columns[c]
    out["reflect"] = columns["intensity"]
    if clustered:
        out["cluster_id"] = columns["cluster_id"]
    return out.tobytes()


def pack_points(points: DataFrame, clustered: bool = False, keys: tuple[str, ...] = ("sensor_id", "frame_id"), mirror: str = "off") -> DataFrame:
    """keys, n_points and data of each frame, in point order; mirrors apply here and nowhere before. Spark sorts the points, and
    a task packs many frames at a time; of a frame it holds the packed records only."""
    from cirrostrat.operators.geometry import mirrored

    y, z = mirrored(F.col("y"), F.col("z"), mirror)
    cols = ["x", "y", "z", "intensity", *["cluster_id"] * clustered]
    source = points.withColumns({"y": y, "z": z}).select(*keys, "pt_idx", *cols)

    names = [*keys, "n_points", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (XYZCI if clustered else XYZI).itemsize
        own, parts = None, []  # keys and records of the frame that may go on

        def last() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([*own, pa.array([len(data) // size], pa.int64()), pa.array([data], pa.binary())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            data = pack_array({c: batch.column(len(keys) + 1 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(cols)}, clustered)
            columns = [batch.column(k) for k in range(len(keys))]
            start = np.flatnonzero(groups.changes(columns))
            if own is not None:
                if not groups.changes([pa.concat_arrays([o, c.slice(0, 1)]) for o, c in zip(own, columns, strict=True)])[1]:
                    parts.append(data[: size * int(start[1])] if len(start) > 1 else data)
                    start = start[1:]
                if len(start):
                    yield last()
            if not len(start):
                continue
            # frames that begin and end in this batch
            n, places = len(start) - 1, start.astype(np.int32)
            if n:
                held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places * np.int32(size)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(places[:-1])) for c in columns], pa.array(np.diff(places).astype(np.int64)), held], names=names)
            own, parts = [c.take(pa.array(places[-1:])) for c in columns], [data[size * int(places[-1]) :]]
        if own is not None:
            yield last()

    kinds = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in keys)
    return source.repartition(*keys).sortWithinPartitions(*keys, "pt_idx").mapInArrow(run, f"{kinds}, n_points long, data binary")


def unpacked(packed: DataFrame, clustered: bool = False, keys: tuple[str, ...] = ("sensor_id", "frame_id")) -> DataFrame:
    """The points of ``packed`` (keys, data): keys, pt_idx and the record's fields."""
    layout = XYZCI if clustered else XYZI
    kinds = {"<f4": "float", "<u4": "long", "|u1": "smallint"}
    fields = [(n, layout.fields[n][0]) for n in layout.names]

    def run(batches):
        wide = {"f": np.float32, "u": np.int64}
        for b in batches:
            data = b.column(len(keys))
            size, rest = np.divmod(pc.binary_length(data).to_numpy(zero_copy_only=False), layout.itemsize)
            if rest.any():
                raise ValueError("a cloud's bytes end inside a record")
            ends, row = np.cumsum(size), 0
            while row < b.num_rows:  # many clouds at a time, or a large one
                to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + UNPACKED, side="right")))
                p, n = np.frombuffer(b"".join(data.slice(row, to - row).to_pylist()), dtype=layout), size[row:to]
                own = [b.column(k).take(pa.array(np.repeat(np.arange(row, to), n))) for k in range(len(keys))]
                place = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*own, pa.array(place.astype(np.int32)), *[pa.array(p[c].astype(np.int16 if t.itemsize == 1 else wide[t.kind])) for c, t in fields]], names=[*keys, "pt_idx", *[c for c, _ in fields]])
                row = to

    types = dict(packed.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "pt_idx int", *[f"{n} {kinds[t.str]}" for n, t in fields]])
    return packed.select(*keys, "data").mapInArrow(run, schema)


def cloud_messages(packed: DataFrame, clustered: bool = False, frame: str = "lidar", ts: str = "ts_ns") -> DataFrame:
    """``packed`` with ``message``, the cloud as a struct."""
    layout = XYZCI if clustered else XYZI
    n = F.col("n_points").cast("int")
    header = F.struct(ros_time(ts).alias("stamp"), F.lit(frame).alias("frame_id"))
    return packed.withColumn(
        "message",
        F.struct(
            header.alias("header"), F.lit(1).alias("height"), n.alias("width"), _fields_column(layout).alias("fields"), F.lit(False).alias("is_bigendian"),
            F.lit(layout.itemsize).alias("point_step"), (n * layout.itemsize).alias("row_step"), F.col("data"), F.lit(True).alias("is_dense"),
        ),
    )


def imu_messages(imu: DataFrame, frame: str = "lidar", ts: str = "ts_ns") -> DataFrame:
    """``imu`` with ``message``: raw axes, identity orientation, zero covariances."""
    v = lambda *c: F.struct(*[(F.col(x) if isinstance(x, str) else F.lit(float(x))).cast("double").alias(k) for x, k in zip(c, "xyzw", strict=False)])
    zero = F.array_repeat(F.lit(0.0), 9)
    return imu.withColumn("message", F.struct(F.struct(ros_time(ts).alias("stamp"), F.lit(frame).alias("frame_id")).alias("header"), v(0, 0, 0, 1).alias("orientation"), zero.alias("orientation_covariance"), v("gyro_x", "gyro_y", "gyro_z").alias("angular_velocity"), zero.alias("angular_velocity_covariance"), v("accel_x", "accel_y", "accel_z").alias("linear_acceleration"), zero.alias("linear_acceleration_covariance")))


def static_transform(spark: SparkSession, base: str = "base_link", lidar: str = "lidar", translation: tuple = (0.0, 0.0, 0.0), rotation: tuple = (0.0, 0.0, 0.0, 1.0)) -> DataFrame:
    """One row: the transform as it is published (it is never applied to points)."""
    v = lambda t: F.struct(*[F.lit(float(x)).alias(k) for x, k in zip(t, "xyzw", strict=False)])
    return spark.range(1).select(F.lit(base).alias("frame_id"), F.lit(lidar).alias("child_frame_id"), v(translation).alias("translation"), v(rotation).alias("rotation"))


class Cdr:
    """Little-endian CDR bytes, aligned from behind the four-byte header."""

    def __init__(self):
        self.out = bytearray(b"\x00\x01\x00\x00")

    def put(self, kind: str, *values) -> Cdr:
        size = struct.calcsize("<" + kind)
        self.out += b"\0" * (-(len(self.out) - 4) % size)
        for v in values:
            self.out += struct.pack("<" + kind, v)
        return self

    def text(self, s: str) -> Cdr:
        raw = s.encode() + b"\0"
        self.put("I", len(raw))
        self.out += raw
        return self

    def octets(self, data: bytes) -> Cdr:
        self.put("I", len(data))
        self.out += data
        return self


def cloud_cdr(sec: int, nanosec: int, frame: str, n: int, layout: np.dtype, data: bytes) -> bytes:
    """CDR bytes of a cloud message."""
    c = Cdr().put("i", sec).put("I", nanosec).text(frame).put("I", 1, n).put("I", len(layout.names))
    for name, offset, kind, count in descriptors(layout):
        c.text(name).put("I", offset).put("B", kind).put("I", count)
    c.put("?", False).put("I", layout.itemsize, layout.itemsize * n).octets(data).put("?", True)
    return bytes(c.out)


def with_cdr(packed: DataFrame, clustered: bool = False, frame: str = "lidar", ts: str = "ts_ns") -> DataFrame:
    """``packed`` with ``cdr``, the serialized cloud message: ``cloud_cdr`` as a column expression. No time is time 0."""
    layout = XYZCI if clustered else XYZI
    empty = cloud_cdr(0, 0, frame, 0, layout, b"")
    width = len(Cdr().put("i", 0).put("I", 0).text(frame).put("I", 1).out)
    ns = F.coalesce(F.col(ts), F.lit(0)).cast("long")
    nanosec, n = F.pmod(ns, F.lit(1_000_000_000)), F.col("n_points").cast("long")
    sec = ((ns - nanosec) / 1_000_000_000).cast("int")  # whole, and below 2 ** 53
    number = lambda v: le_bytes(v, 4)
    cdr = F.concat(
        F.lit(empty[:4]), number(sec), number(nanosec), F.lit(empty[12:width]), number(n), F.lit(empty[width + 4 : -9]),
        number(n * layout.itemsize), number(F.octet_length("data")), F.col("data"), F.lit(empty[-1:]),
    )
    return packed.withColumn("cdr", cdr)


def viewer_points(points: DataFrame) -> DataFrame:
    """Positions and grey colours as a viewer takes them."""
    grey = F.col("intensity").cast("int")
    return points.select("frame_id", "pt_idx", F.array("x", "y", "z").alias("position"), F.struct(grey.alias("r"), grey.alias("g"), grey.alias("b")).alias("color"))
