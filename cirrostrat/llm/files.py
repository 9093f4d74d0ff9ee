"""Binary files in the shared folder, written by executors and read through Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def put(folder: str, name: str, data: bytes) -> str:
    """Write ``folder/name`` whole or not at all: a second attempt of a lost task replaces it by equal bytes."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{root}/{name}")
    return f"{root}/{name}"


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and content of the files, by Spark's own reader (any Hadoop file system)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
