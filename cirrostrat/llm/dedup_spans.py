"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` (20) consecutive words of one document; every word covered by a window whose word sequence also
starts earlier is removed.

1. Anchors. Of the 8-word sequences only those at positions that are 0, 1, 3 or 9 modulo 13 are hashed. These
   residues form a difference cover, so two equal windows, wherever they start, have an anchor at one common offset of
   0 to 12 words, and it lies inside both. An anchor seen once in the corpus can't belong to a repeated window.
2. Extension. The windows around anchors seen twice or more are hashed whole (96 bits of two polynomial hashes travel).
   Of equal windows all but the earliest are repeats.
3. The words that repeats cover are removed.

Both look-ups send packed arrays to hash buckets of bounded size. A task first settles what repeats among its own
documents: of an anchor that it meets in chunk after chunk it sends two entries, of a window one for its group of
documents. So a passage in a third of all documents costs a bucket an entry or two per task. What a bucket finds goes back in one packed row per group of documents (a hash range of keys, about
``GROUP_CHARS`` characters of text); both ways back to the texts share one shuffle of them.

Defined cases: null or empty texts have no words; null doc_ids come after all others; rows equal in id and text count as
one document (each gets its result); rows with one id and different texts are ordered by a hash of the text; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import bounded, chunks, written

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_ENTRIES = 1_500_000
#: Words whose hashes a task keeps, and the bytes of the longest of them: some 100 MB at most. Longer ones are hashed anew.
HASHES_KEPT, KEPT_BYTES = 500_000, 128
#: Anchors that a task has met in two chunks running, kept at most; one that is forgotten is sent again.
COMMON_KEPT = 200_000
GROUP_CHARS = 16_000_000

_B = [np.array([x], dtype=np.uint64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]  # arrays wrap around silently


class _Hashes(dict):
    """64-bit hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word, 8)
        if len(word) <= KEPT_BYTES:
            if len(self) >= HASHES_KEPT:
                self.clear()
            self[word] = value
        return value


def _words(texts: list[str | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in a row, and the first word's index for each text and the end."""
    split = [t.encode().split() if t else [] for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    return np.fromiter((known[w] for s in split for w in s), dtype=np.uint64, count=int(starts[-1])), starts


def _rolled(h: np.ndarray, length: int, base: np.ndarray) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values, by doubling."""
    parts, run, size, power = [], h, 1, base
    while True:
        if length & size:
            parts.append((run, size, power))
        if size * 2 > length:
            break
        run = run[:-size] * power + run[size:] if len(run) > size else run[:0]
        power, size = power * power, size * 2
    out, done = None, 0
    for run, size, power in reversed(parts):
        n = max(0, len(h) - length + 1)
        out = run[:n].copy() if out is None else out * power + run[done : done + n]
        done += size
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("data", pa.binary())])
_SENT_SQL = "bucket int, kind tinyint, n int, data binary"
_FOUND_SQL = "part int, n int, data binary"


def _to_buckets(hashes: np.ndarray, columns: list[np.ndarray], n_buckets: int, kind: int) -> list[tuple]:
    """(bucket, kind, n, packed hashes and columns) by bucket of the first hash."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
    return [(b, kind, int(z - a), _pack(*[c[order[a:z]] for c in columns])) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]


def _settled(key: np.ndarray, pos: np.ndarray, n_buckets: int) -> list[tuple]:
    """Positions that a task already knows, passed on through their document's bucket."""
    return _to_buckets(_mixed(key.view(np.uint64)), [key, pos], n_buckets, 1) if len(key) else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_SENT)], schema=_SENT)


def _anchors(n_buckets: int):
    def send(batches):
        known = _Hashes()
        before = common = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                h, starts = _words(texts[a:b], known)
                at = np.arange(max(0, len(h) - ANCHOR + 1))
                doc = np.searchsorted(starts, at, side="right") - 1
                pos = at - starts[doc]
                ok = np.isin(pos % PERIOD, COVER) & (at + ANCHOR <= starts[doc + 1]) & (np.diff(starts)[doc] >= WINDOW)
                at, doc, pos = at[ok], doc[ok], pos[ok].astype(np.uint32)
                x = _mixed(_rolled(h, ANCHOR, _B[0])[at]) if len(at) else np.zeros(0, dtype=np.uint64)
                key = keys[a:b][doc]
                found, first, inverse, count = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
                sent = np.isin(found, common, assume_unique=True)  # two entries have gone to the bucket, so all others are settled
                more = (count > 1)[inverse] | sent[inverse]
                entry = np.sort(first[~sent])
                again = np.intersect1d(found, before, assume_unique=True)
                common, before = np.union1d(common, again) if len(common) + len(again) <= COMMON_KEPT else again[:COMMON_KEPT], found
                rows = _to_buckets(x[entry], [x[entry], key[entry], pos[entry], more[entry]], n_buckets, 0) + _settled(key[more], pos[more], n_buckets)
                if rows:
                    yield _batch(rows)

    return send


def _entries(table: pa.Table, kinds: list) -> list[np.ndarray]:
    """The columns of a bucket's entries of kind 0, joined."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for kind, n, data in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("data"), strict=True):
        if kind == 0:
            at = 0
            buffer = data.as_buffer()
            for k, t in enumerate(kinds):
                out[k].append(np.frombuffer(buffer, dtype=t, count=n, offset=at))
                at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(out, kinds, strict=True)]


def _part(key, parts: int):
    """The group of a document's key, for numpy keys and for columns alike."""
    if isinstance(key, np.ndarray):
        k = key.view(np.uint64)
        return ((k ^ (k >> np.uint64(15)) ^ (k >> np.uint64(31))) & np.uint64((1 << 63) - 1)) % np.uint64(parts)
    mixed = key.bitwiseXOR(F.shiftrightunsigned(key, 15)).bitwiseXOR(F.shiftrightunsigned(key, 31))
    return (mixed.bitwiseAND(F.lit((1 << 63) - 1)) % parts).cast("int")


def _by_part(key: np.ndarray, pos: np.ndarray, parts: int) -> pa.Table:
    """Positions of documents packed into one row per group of documents."""
    part = _part(key, parts)
    order = np.lexsort((pos, key, part))
    key, pos, part = key[order], pos[order], part[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]]) if len(key) else np.zeros(1, dtype=np.int64)
    return pa.table({"part": pa.array(part[cuts[:-1]], pa.int32()), "n": pa.array(np.diff(cuts), pa.int32()), "data": pa.array([_pack(key[a:z], pos[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _unpacked(table: pa.Table, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of packed rows (of that kind, if rows have kinds)."""
    keys, positions = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    kinds = table.column("kind").to_pylist() if kind is not None else [None] * len(table)
    for k, n, data in zip(kinds, table.column("n").to_pylist(), table.column("data"), strict=True):
        if k == kind:
            keys.append(np.frombuffer(data.as_buffer(), dtype=np.int64, count=n))
            positions.append(np.frombuffer(data.as_buffer(), dtype=np.uint32, count=n, offset=8 * n))
    return np.concatenate(keys), np.concatenate(positions)


def _found_in(docs: pa.Table, found: pa.Table) -> list[np.ndarray]:
    """The positions found in each document of a group, sorted and distinct."""
    key, pos = _unpacked(found)
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    own = docs.column("key").to_numpy()
    return [np.unique(pos[a:z]).astype(np.int64) for a, z in zip(np.searchsorted(key, own), np.searchsorted(key, own, side="right"), strict=True)]


def _shared(parts: int):
    def find(table: pa.Table) -> pa.Table:
        """Anchors of this bucket that occur twice or more."""
        x, key, pos, more = _entries(table, [np.uint64, np.int64, np.uint32, bool])
        order = np.argsort(x, kind="stable")
        s = x[order]
        equal = np.zeros(len(s), dtype=bool)
        equal[1:] = s[1:] == s[:-1]
        equal[:-1] |= equal[1:]
        found = np.zeros(len(s), dtype=bool)
        found[order] = equal
        found &= ~more  # those are settled
        k, p = _unpacked(table, 1)
        return _by_part(np.concatenate([key[found], k]), np.concatenate([pos[found], p]), parts)

    return find


def _windows(n_buckets: int):
    def send(docs: pa.Table, found: pa.Table) -> pa.Table:
        known, out = _Hashes(), []
        docs = docs.sort_by("key")  # so that a window's first entry is the earliest of the group
        sent_x = sent_y = np.zeros(0, dtype=np.uint64)
        keys, texts, positions = docs.column("key").to_numpy(), docs.column("text").to_pylist(), _found_in(docs, found)
        for a, b in chunks(texts):
            if not any(len(p) for p in positions[a:b]):
                continue
            h, starts = _words(texts[a:b], known)
            ats = []
            for i in range(b - a):
                w = np.unique((positions[a + i][:, None] - np.arange(PERIOD)).ravel())
                ats.append(w[(w >= 0) & (w <= int(starts[i + 1] - starts[i]) - WINDOW)] + starts[i])
            at = np.concatenate(ats)
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            pos, key = (at - starts[doc]).astype(np.uint32), keys[a:b][doc]
            x, y = (_mixed(_rolled(h, WINDOW, base)[at]) for base in _B)
            order = np.lexsort((pos, key, y, x))
            s, t = x[order], y[order]
            again = np.zeros(len(s), dtype=bool)
            again[1:] = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
            fresh = order[~again]
            if len(sent_x):
                place = np.minimum(np.searchsorted(sent_x, x[fresh]), len(sent_x) - 1)
                had = (sent_x[place] == x[fresh]) & (sent_y[place] == y[fresh])
                again[~again] = had
                fresh = fresh[~had]
            sent_x, unique = np.unique(np.concatenate([sent_x, x[fresh]]), return_index=True)
            sent_y = np.concatenate([sent_y, y[fresh]])[unique]
            entry, repeat = np.sort(fresh), order[again]
            y32 = (y[entry] >> np.uint64(32)).astype(np.uint32)
            out.append(_batch(_to_buckets(x[entry], [x[entry], y32, key[entry], pos[entry]], n_buckets, 0) + _settled(key[repeat], pos[repeat], n_buckets)))
        return pa.Table.from_batches(out, schema=_SENT)

    return send


def _repeats(parts: int):
    def find(table: pa.Table) -> pa.Table:
        """Of equal windows of this bucket all but the earliest."""
        x, y, key, pos = _entries(table, [np.uint64, np.uint32, np.int64, np.uint32])
        order = np.lexsort((pos, key, y, x))
        again = np.zeros(len(x), dtype=bool)
        again[1:] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        k, p = _unpacked(table, 1)
        return _by_part(np.concatenate([key[order[again]], k]), np.concatenate([pos[order[again]], p]), parts)

    return find


def _kept(with_text: bool):
    def keep(docs: pa.Table, found: pa.Table) -> pa.Table:
        totals, removed, digests, kept_texts = [], [], [], []
        for text, starts in zip(docs.column("text").to_pylist(), _found_in(docs, found), strict=True):
            words = text.encode().split() if text else []
            kept = words
            if len(starts):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[starts] += 1
                edge[starts + WINDOW] -= 1
                kept = [w for w, covered in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not covered]
            joined = b" ".join(kept)
            totals.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept_texts.append(joined.decode() if with_text else None)
        return pa.table([docs.column("key"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])

    return keep


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(distinct documents as (key, text), (doc_id, key) of every row or None where the key is the id). Keys are ordered
    as the ids are: the id itself where ids are unique, else a row number over the sorted (id, hash of the text)."""
    docs = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == ids == distinct:
        return docs.withColumnRenamed("doc_id", "key"), None
    pairs = docs.select("doc_id", F.xxhash64("text").alias("tie")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    numbered = written(pairs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, tie long, key long"), "keys")
    rows = docs.join(numbered, docs["doc_id"].eqNullSafe(numbered["id"]) & (F.xxhash64("text") == numbered["tie"]))
    return rows.select("key", "text").dropDuplicates(["key"]), rows.select("doc_id", "key")


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by one space; null unless
    ``with_text``) of every row of ``docs`` (doc_id, text)."""
    texts, rows = _numbered(docs)
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-chars * len(COVER) // (5 * PERIOD) // BUCKET_ENTRIES))
    parts = _prime(max(least, -(-chars // GROUP_CHARS)))
    deal = lambda df, f: df.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(f, _FOUND_SQL)
    grouped = texts.withColumn("part", _part(F.col("key"), parts))
    beside = lambda found, f, kinds: grouped.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(f, kinds)
    anchored = deal(texts.mapInArrow(_anchors(buckets), _SENT_SQL), _shared(parts))
    repeats = deal(beside(anchored, _windows(buckets), _SENT_SQL), _repeats(parts))
    out = beside(repeats, _kept(with_text), "key long, n_words long, n_removed long, kept_sha256 string, kept string")
    named = out.withColumnRenamed("key", "doc_id") if rows is None else rows.join(out, "key")
    return named.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=False).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM v),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) t(j)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
p AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.i WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
