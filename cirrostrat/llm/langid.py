"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded, hash-chosen sample of at most about ``SAMPLE_DOCS`` labelled documents (every one
where there are fewer); the log-probability matrix (``BUCKETS`` rows, one column per language) is broadcast, its size
fixed by those two numbers. Scoring gathers the matrix rows of all n-grams of whole texts in chunks; a very long text is cut
into pieces whose sums are added, so beside the text and its cleaned copies memory doesn't grow with it.

The predicted language is the one of the highest posterior. Its score is the posterior with the log-likelihood divided by
the square root of the number of n-grams, as neighbouring n-grams aren't independent.

Defined cases: ``und`` with score 0 for null texts and texts without a letter; documents with null ids are never held
out nor learned from; ties go to the language first in code point order; without any labelled document everything is
``und``; rows are independent, so repeats repeat; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import CHUNK_CHARS, bounded, chunks, remainder

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_DOCS = 10_000
SEED = 1
MOD, HELD = 4, 2

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PAD = " " * (max(ORDERS) - 1)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def clean(text: str | None) -> str:
    """Lower-case words of letters, one space apart and around; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} {_PAD}" if words else ""


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the buckets of the n-grams at every position of the joined cleaned texts, and each text's first
    position and the one after its last. No n-gram of a text reaches into the next one."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    out, h = [], np.zeros(len(x), dtype=np.uint64)
    for n in ORDERS:
        h[: len(x) - n + 1] += x[n - 1 :] * _MULT[n - 1]
        mixed = h ^ (h >> np.uint64(29)) ^ np.uint64(n * 0x51ED)
        out.append((mixed * _MULT[0] >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return out, ends - sizes, np.where(sizes > 0, ends - len(_PAD), ends)


def pieces(texts: list[str], size: int) -> tuple[list[str], list[int]]:
    """Cleaned texts cut into pieces of ``size`` n-gram positions, and the text of each: a piece goes on for the length of the
    padding, so the pieces' n-grams are the text's, each once."""
    out, owners = [], []
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - len(_PAD)), size):
            out.append(t if len(t) <= size else t[start : start + size + len(_PAD)])
            owners.append(i)
            if len(t) <= size:
                break
    return out, owners


def _counted(batches):
    """Partial counts of a partition: lang, bucket, n."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = [clean(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
        for lang in langs:
            docs[lang] = docs.get(lang, 0) + 1
        parts, owners = pieces(texts, CHUNK_CHARS)
        for a, b in chunks(parts):
            buckets, starts, ends = grams(parts[a:b])
            for i, s, e in zip(owners[a:b], starts.tolist(), ends.tolist(), strict=True):
                c = counts.setdefault(langs[i], np.zeros(BUCKETS, dtype=np.int64))
                for h in buckets:
                    c += np.bincount(h[s:e], minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(c[at], docs[lang]), pa.int64())], names=["lang", "bucket", "n"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, alpha: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix, log priors) from ``docs`` (doc_id, text, lang) that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", MOD) != HELD))
    share = min(1.0, sample_docs / max(1, known.select("doc_id").count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 30)) < int(share * (1 << 30))).where("text is not null")
    parts = bounded(sample).select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    at = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    prior[at[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    return langs, (np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * BUCKETS)).astype(np.float32), np.log(prior / max(1.0, prior.sum()))


def predict(texts: list[str | None], langs: list[str], logs: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    cleaned = [clean(t) for t in texts]
    limit = max(1 << 14, (1 << 22) // max(4, len(langs)))
    likely, n = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts), dtype=np.int64)
    parts, owners = pieces(cleaned, limit)
    for a, b in chunks(parts, limit):
        buckets, starts, ends = grams(parts[a:b])
        total = np.zeros((len(buckets[0]) + 1, max(1, len(langs))))
        if langs:
            row = logs[buckets[0]]
            for h in buckets[1:]:
                row += logs[h]
            np.cumsum(row, axis=0, dtype=np.float64, out=total[1:])
        np.add.at(likely, owners[a:b], total[ends] - total[starts])
        np.add.at(n, owners[a:b], (ends - starts) * len(ORDERS))
    best = (likely + (prior if langs else 0)).argmax(axis=1) if len(texts) else np.zeros(0, dtype=np.int64)
    likely = likely / np.sqrt(np.maximum(1, n))[:, None] + (prior if langs else 0)
    likely -= likely.max(axis=1, keepdims=True)
    p = np.exp(likely)
    p /= p.sum(axis=1, keepdims=True)
    known = [bool(t and langs) for t in cleaned]
    names = [langs[k] if ok else "und" for ok, k in zip(known, best.tolist(), strict=True)]
    scores = [min(1.0, x) if ok else 0.0 for ok, x in zip(known, p[np.arange(len(p)), best].tolist(), strict=True)]
    return names, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = predict(batch.column(2).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder("doc_id", MOD) == HELD, F.lit(False)).alias("held_out")
    return bounded(docs).select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
