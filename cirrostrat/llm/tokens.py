"""Token ids of documents as wavelet-matrix shards.

Documents are encoded where they are read; their ids (two bytes each where the vocabulary allows it) move once, to the
task of their doc_id range, which sorts and streams them into files of about ``FILE_TOKENS`` ids. The files are read
back by Spark's binary reader; the sums of tokens before each file are a small table joined to the documents.

Ranges hold about ``RANGE_CHARS`` characters each: a narrow table (id, hash and length of each text) is sorted by Spark,
and every task cuts its stretch of it. Only the cuts, 24 bytes each, come to the driver and go to the tasks.

For the word tokenizer (``WordEncoder.fits``) a word between white space always encodes alike, so each distinct word is
encoded once and a bounded table keeps the words seen before: its normalizer and its pre-tokenizer never look across
white space. Words go to the tokenizer as they are, but for ASCII letters, lower-cased where no mark follows one.
Words of plain letters and marks of punctuation, for which its pre-tokenizer's rule is plain, go to its merge model
directly. Whole texts go to any other tokenizer.

Defined cases: null and empty texts have the end id alone; documents are ordered by doc_id, nulls last, equal ids by a
hash of the text; an empty table writes no shard and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.llm import files, wavelet
from cirrostrat.llm.common import bounded, chunks, scratch, written

END_ID = 2
RANGE_CHARS = 16_000_000
#: Rows that a task cuts into ranges, and the most tasks that cut or write (a task may have several ranges).
CUT_ROWS, MOST_CUTTERS, MOST_WRITERS = 20_000, 4_096, 65_536
FILE_TOKENS = 4_000_000
#: Bytes of the table of known words, with about WORD_BYTES for what Python adds to a word and its ids.
TABLE_BYTES, WORD_BYTES = 120_000_000, 150

# The pieces of the word tokenizer's description that WordEncoder is right for.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = ".,;:!?#$%&*()[]{}|/-+=\""
#: Letters that are words to the pre-tokenizer and that its normalizer leaves alone: ASCII and Latin ones in lower case.
_PLAIN = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c) and c not in (0xAA, 0xBA))
_WORD = re.compile(f"([{_PLAIN}]+)([{re.escape(_PUNCTUATION)}]*)")
#: A capital that a mark may join: lower-casing it first could change what the two become.
_JOINED = re.compile("[A-Z][\u0300-\U0010ffff]")
#: The byte-level alphabet: bytes that don't print stand for code points from 256 on.
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_ENCODERS: dict[str, "WordEncoder | TextEncoder"] = {}


class TextEncoder:
    """Encodes whole texts with the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder(TextEncoder):
    """Encodes texts word by word, each distinct word once."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        super().__init__(path)
        self.most, self.known, self.size = table_bytes, {}, 0
        self.code = "H" if self.dtype == "<u2" else "I"

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the tokenizer at ``path`` is the kind that this encoder is right for."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        steps, model = d["pre_tokenizer"] or {}, d["model"]
        split, level, *more = [*steps.get("pretokenizers", ()), {}, {}]
        return (
            d["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS} and split == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True} and not any(more)
            and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and d["truncation"] is None
            and model["type"] == "BPE" and not model["dropout"] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in d["added_tokens"])
        )

    def _piece(self, letters: str) -> bytes:
        """Ids of a word of plain letters: one piece to the tokenizer."""
        seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        rest = []
        for w in words:
            m = _WORD.fullmatch(w)
            if m:
                core, tail = m.groups()
                if core not in self.known:
                    self.known[core] = self._piece(core)
                if tail:
                    if tail not in self.known:
                        self.known[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
                    self.known[w] = self.known[core] + self.known[tail]
            else:
                rest.append(w)
        for w, ids in zip(rest, super().encode(rest), strict=True):
            self.known[w] = ids
        self.size += 4 * sum(map(len, words)) + WORD_BYTES * len(words)

    @staticmethod
    def split(text: str) -> list[str]:
        """Words of a text, with ASCII letters lower-cased where the tokenizer does no more to them in any context."""
        if not text:
            return []
        if "<|" not in text and (text.isascii() or not _JOINED.search(text)):
            text = text.encode().lower().decode()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return [w for w in re.split("[ \t\n\r]+", text) if w]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        words, ends = [], [0]
        for t in texts:
            words += self.split(t)
            ends.append(len(words))
        ids = list(map(self.known.get, words))
        new = {w for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            if self.size > self.most:
                self.known.clear()
                self.size, new = 0, set(words)
            self._learn(new)
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str) -> WordEncoder | TextEncoder:
    """This process's encoder, with what it has learned from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path) if WordEncoder.fits(path) else TextEncoder(path)
    return _ENCODERS[path]


def _places(ids: pa.Array, ties: pa.Array) -> np.ndarray:
    """The order of (doc_id, nulls last, tie) as comparable bytes."""
    out = np.zeros((len(ids), 3), dtype=">u8")
    out[:, 0] = np.asarray(ids.is_null())
    low = np.uint64(1 << 63)
    out[:, 1] = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ low
    out[:, 2] = ties.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ low
    return out.view("S24").ravel()


def range_cuts(docs: DataFrame, rows: int, range_chars: int = RANGE_CHARS) -> np.ndarray:
    """Sorted places at which ranges of about ``range_chars`` characters of ``docs`` (doc_id, tie, chars) start."""

    def cut(batches):
        have = range_chars  # a task's first row starts a range
        for batch in batches:
            starts = []
            for n, c in enumerate(batch.column(2).to_pylist()):
                if have >= range_chars:
                    starts.append(n)
                    have = 0
                have += c
            places = _places(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([places[n].ljust(24, b"\0") for n in starts], pa.binary())], names=["place"])

    tasks = min(MOST_CUTTERS, max(1, -(-rows // CUT_ROWS)))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie")]
    in_order = docs.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    places = in_order.mapInArrow(cut, "place binary").toArrow().column("place").to_pylist()
    return np.unique(np.array(places, dtype="S24"))[1:]  # what lies before the first cut is the first range


def _encoder(path: str, cuts: np.ndarray, end_id: int):
    out = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        own = encoder(path)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in batches:
            doc_ids, texts, ties = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            ranges = np.searchsorted(cuts, _places(doc_ids, ties), side="right")
            for a, b in chunks(texts):
                ids = [x + end for x in own.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(ranges[a:b], pa.int32()), doc_ids.slice(a, b - a), ties.slice(a, b - a), pa.array(ids, pa.binary())], schema=out)

    return encode


def _writer(folder: str, dtype: str):
    kinds = pa.schema([("file", pa.string()), ("n_tokens", pa.int64())])

    def write(batches):
        """Sorted rows (range, doc_id, ids) into files; a file ends with its range or when it is full."""
        _ENCODERS.clear()  # this process may have encoded before
        part, now, doc_ids, lengths, size, sub = [], None, [], [], 0, 0

        def done():
            ids = np.frombuffer(b"".join(part), dtype=dtype)
            part.clear()
            name = f"shard-{now:08d}-{sub:06d}.wm"
            files.put(folder, name, wavelet.dump(wavelet.WaveletMatrix.build(ids), doc_ids, np.array(lengths, dtype=np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], schema=kinds)

        for batch in batches:
            for rng, doc, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(ids) // np.dtype(dtype).itemsize
                if part and (rng != now or size + n > FILE_TOKENS):
                    yield done()
                    sub = sub + 1 if rng == now else 0
                    doc_ids, lengths, size = [], [], 0
                now, size = rng, size + n
                part.append(ids)
                doc_ids.append(doc)
                lengths.append(n)
        if part:
            yield done()

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns it and a table of the files: file, n_tokens."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    docs = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = range_cuts(docs.select("doc_id", "tie", F.length("text").cast("long").alias("chars")), docs.count())
    encoded = docs.select("doc_id", "text", "tie").mapInArrow(_encoder(tokenizer_path, cuts, end_id), "range int, doc_id long, tie long, ids binary")
    order = [F.col("range"), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    in_order = encoded.repartition(min(MOST_WRITERS, len(cuts) + 1), "range").sortWithinPartitions(*order).select("range", "doc_id", "ids")
    dtype = TextEncoder(tokenizer_path).dtype
    return folder, written(in_order.mapInArrow(_writer(folder, dtype), "file string, n_tokens long"), "manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """file and the tokens of all files before it: sums within a thousand ranges, then over the thousands."""
    part = F.expr("cast(substring(file, 7, 8) as int) div 1000")
    marked = manifest.withColumn("part", part)
    parts = marked.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("own", own).join(before, "part").select("file", (F.col("own") + F.col("base")).alias("base"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document read back: doc_id, start, n_tokens, ids_crc32 and its file."""

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, doc_ids, lengths = wavelet.load(content.as_buffer())
                ids = matrix.decode().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]] * len(crcs)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    rows = files.contents(spark, folder, "*.wm").mapInArrow(decode, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(_starts(manifest), "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file")


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    folder, manifest = write_shards(docs, tokenizer_path)
    return read_shards(docs.sparkSession, folder, manifest)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenized(docs, default_tokenizer()).drop("file")
