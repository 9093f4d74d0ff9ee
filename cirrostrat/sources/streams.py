"""Packet streams: a UDP socket as a streaming source, and finite or repeating sources for tests."""

from __future__ import annotations

import logging
import socket
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

log = logging.getLogger(__name__)


class UdpDataSource(DataSource):
    """``spark.readStream.format("udp_packets")`` with options host, port, target (only that sender) and wait_ms.

    One reader drains the socket on the driver and hands packets on in order. Packets that were handed out but not
    committed are kept and replayed; a socket has no offsets to seek back to after a restart, so for exactly-once use
    land packets as files first (``landed``)."""

    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return "capture_seq long, ts_ns long, src_ip string, src_port int, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _UdpReader(self.options)


class _UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.target = options.get("target") or None
        self.wait = int(options.get("wait_ms", "50")) / 1000
        self.most = int(options.get("max_packets", "10000"))
        self.kept: dict[int, tuple] = {}
        self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 16 << 20)
        self.sock.bind((options.get("host", "0.0.0.0"), int(options.get("port", "6699"))))
        self.sock.settimeout(self.wait)

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict):
        seq, out, until = start["seq"], [], time.monotonic() + self.wait
        while len(out) < self.most and time.monotonic() < until:
            try:
                payload, (ip, port) = self.sock.recvfrom(65_535)
            except TimeoutError:
                break
            except OSError as e:  # one that a packet caused: the next one may be good
                log.warning("packet skipped: %s", e)
                continue
            if self.target is None or ip == self.target:
                row = (seq, time.time_ns(), ip, port, payload)
                self.kept[seq] = row
                out.append(row)
                seq += 1
        return iter(out), {"seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.kept[i] for i in range(start["seq"], end["seq"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["seq"]]:
            del self.kept[i]


def landed(spark: SparkSession, folder: str, schema: str, max_files: int = 8) -> DataFrame:
    """Packets landed as Parquet files, a bounded number a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def finite(spark: SparkSession, payloads: list[bytes], buffer: int | None = None) -> DataFrame:
    """Test packets in order, cut to the receive buffer."""
    return spark.createDataFrame([(i, bytearray(p[:buffer] if buffer is not None else p)) for i, p in enumerate(payloads)], "capture_seq long, payload binary")


def looping(packets: DataFrame, times: int) -> DataFrame:
    """The packets over and over, numbered on; an empty source stays empty."""
    n = packets.count()
    rounds = packets.sparkSession.range(times).withColumnRenamed("id", "__round")
    return packets.join(F.broadcast(rounds)).withColumn("capture_seq", F.col("capture_seq") + F.col("__round") * n).drop("__round")


def remaining(packets: DataFrame, from_seq: int) -> DataFrame:
    """Packets from a cursor on."""
    return packets.where(F.col("capture_seq") >= from_seq)
