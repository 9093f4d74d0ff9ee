"""Plumbing that the text operators share: tables in the shared folder, row keys, bounded chunks of text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.tables import scratch, shared_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "CHUNK_CHARS", "WORD", "base32", "bounded", "chunks", "free", "remainder", "scratch", "shared_dir", "written"]

#: A word of the contracts: a run of characters that are not ASCII white space (bytes.split() splits alike).
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one numpy step handles at a time (a longer document is handled alone).
CHUNK_CHARS = 1 << 20


#: Rows and bytes of an Arrow batch: Spark's own limit is ten thousand rows of any length.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for long texts (a smaller setting is left alone)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (None counts as empty) of about ``limit`` characters each; every text is in one range."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def free(name: str, taken: list[str]) -> str:
    """``name``, with as many further underscores as keep it apart from the columns in ``taken``."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hex string (20 bits at a time)."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
