"""Logs of serialized messages by topic, written in two phases.

Tasks write whole files under ``staging/JOB``, which nobody reads. At the commit the driver moves the files of the tasks that
count into a folder under ``data`` and then writes ``commits/JOB.json``, which names them: that one file makes the job's messages part
of the log, all or none. What failed or repeated attempts left is removed with the staging folder, at a commit or an abort. A
job may have a name (option ``commit``): one that is in the log already is not added again. A stream must have one, of its
own, and its micro-batches add their numbers to it, so one that is tried again writes nothing twice.

A file holds one topic: its size (uint32) and name, then records of time (int64, ns), size (uint32) and message, little-endian.
A null topic is an empty one, a null time 0, a null message empty. The folder is one that
driver and executors share, on a file system that Arrow knows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

SCHEMA = "topic string, ts_ns long, data binary"
#: Bytes of messages that are read at a time.
HELD = 16 << 20
_RECORD, _SIZE = struct.Struct("<qI"), struct.Struct("<I")


def _system(folder: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa_fs.LocalFileSystem(), folder)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Job:
    """The two phases of one job."""

    def __init__(self, folder: str, name: str):
        self.folder, self.staged = folder, f"staging/{quote(name, safe='')}"

    def put(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """A task's files, one a topic."""
        system, root = _system(self.folder)
        open_: dict[str, tuple[str, object]] = {}
        for batch in batches:
            for topic, ts, message in zip(batch.column("topic").to_pylist(), batch.column("ts_ns").to_pylist(), batch.column("data"), strict=True):
                if topic not in open_:
                    at, name = f"{uuid.uuid4().hex}.log", (topic or "").encode()
                    system.create_dir(f"{root}/{self.staged}", recursive=True)
                    open_[topic] = at, system.open_output_stream(f"{root}/{self.staged}/{at}")
                    open_[topic][1].write(_SIZE.pack(len(name)) + name)
                data = message.as_buffer() if message.is_valid else b""  # not copied
                open_[topic][1].write(_RECORD.pack(ts or 0, len(data)))
                open_[topic][1].write(data)
        for _, file in open_.values():
            file.close()
        return _Written([at for at, _ in open_.values()])

    def keep(self, name: str, messages: list[_Written | None]) -> None:
        system, root = _system(self.folder)
        commit = f"{root}/commits/{quote(name, safe='')}.json"
        if system.get_file_info(commit).type == pa_fs.FileType.NotFound:
            own = f"data/{uuid.uuid4().hex}"
            files = [at for m in messages if m is not None for at in m.files]
            for to in (f"{root}/{own}", f"{root}/commits"):
                system.create_dir(to, recursive=True)
            for at in files:
                system.move(f"{root}/{self.staged}/{at}", f"{root}/{own}/{at}")
            part = f"{root}/commits/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(json.dumps([f"{own}/{at}" for at in files]).encode())
            system.move(part, commit)
        self.drop()

    def drop(self) -> None:
        system, root = _system(self.folder)
        if system.get_file_info(f"{root}/{self.staged}").type != pa_fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staged}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.name = options.get("commit") or uuid.uuid4().hex
        self.job = _Job(options["path"], self.name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.job.put(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.job.keep(self.name, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.job.drop()


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options):
        if not options.get("commit"):
            raise ValueError("a stream into a message log needs a name of its own in the option commit")
        self.name = options["commit"]  # not made up: tasks and commits come from copies of this writer that Spark makes apart
        self.job = _Job(options["path"], self.name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.job.put(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.job.keep(f"{self.name}-{batchId}", messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.job.drop()


class MessageLog(DataSource):
    """``df.write.format("message_log").option("path", folder)``, or a stream's ``writeStream``: rows of ``SCHEMA``. Option
    ``commit`` names the job (of a stream: its micro-batches, with their numbers)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options)


def append(messages: DataFrame, folder: str, commit: str | None = None) -> None:
    """Add ``messages`` (topic, ts_ns, data) to the log in ``folder``, once for each name in ``commit``."""
    spark = messages.sparkSession
    spark.dataSource.register(MessageLog)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:  # a task gets so much, or one larger message
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", HELD)
    writer = messages.select("topic", F.col("ts_ns").cast("long").alias("ts_ns"), "data").write.format("message_log").mode("append").option("path", folder)
    (writer.option("commit", commit) if commit else writer).save()


def _records(file) -> Iterator[pa.RecordBatch]:
    """The messages of an open file, record by record: ``HELD`` bytes of them at a time, or a larger one."""
    topic = file.read(_SIZE.unpack(file.read(_SIZE.size))[0]).decode()
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([topic] * len(rows)), pa.array([ts for ts, _ in rows], pa.int64()), pa.array([data for _, data in rows], pa.binary())], names=["topic", "ts_ns", "data"])

    while head := file.read(_RECORD.size):
        ts, size = _RECORD.unpack(head)
        if rows and held + size > HELD:
            yield batch()
            rows, held = [], 0
        if len(data := file.read(size)) < size:
            raise ValueError("a message of the log is cut short")
        rows.append((ts, data))
        held += size
    if rows:
        yield batch()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """topic, ts_ns and data of every message of the log's committed jobs."""
    system, root = _system(folder)
    found = system.get_file_info(pa_fs.FileSelector(f"{root}/commits", allow_not_found=True))
    files = [f for c in found if c.base_name.endswith(".json") for f in json.loads(system.open_input_file(c.path).read())]
    if not files:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{at}", buffer_size=1 << 20) as file:
                    yield from _records(file)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 10_000)).mapInArrow(run, SCHEMA)
