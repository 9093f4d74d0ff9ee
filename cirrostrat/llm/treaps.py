"""Ranked lexical search with inverted treaps.

A term's postings in a shard are a treap: documents in search order, impacts in heap order, so the root of a subtree bounds
all that lie below it. A query's treaps are traversed together. A stretch of documents is bounded by the sum, over the
query's terms, of the weighted impact at the root of the subtree that covers it; stretches whose sum cannot reach the
k-th best score found so far are left, the others are split at the root with the largest share, best bounds first. A
stretch of ``LEAF`` documents or fewer is scored at once. Equal impacts are put in heap order by a hash of the document, so
a run of copies is no chain.

1. Words of whole texts are counted once; a row per document keeps its length and the counts of the terms that are asked
   for. These rows are a table in the shared folder; sums over it give the corpus counts.
2. A task takes its rows in shards of about ``SHARD`` postings, builds their treaps, searches them for all items, and
   carries each item's best k from shard to shard. Memory is that of one shard.
3. A task gives k rows an item at most; they meet by salts of the document, then by item.

The items are a query set against all rows: in blocks of at most ``BLOCK_CHARS`` characters, each of which is what is
broadcast, and a pass over the documents.

Defined cases: null texts and texts without terms score nothing and don't count; null ids come last among equal scores;
rows that repeat an id are documents of their own, items that repeat an id are ranked each; items without terms, or whose
terms no document has, give no rows; terms that nearly all documents have weigh nothing; a very long text is counted in
pieces of ``PIECE`` bytes; either table may be empty; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.llm.common import bounded, written

K = 50
LEAF, WIDE = 64, 64
SHARD = 2_000_000
BLOCK_CHARS = 1_000_000
PIECE = 1 << 20
SALTS = 32
#: A-Z as a-z, other letters and digits and all of a character beyond ASCII as they are, anything else as a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    text, start = text.translate(_TERMS), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def treap(key: list) -> tuple[list, list, int]:
    """Left and right children (-1: none) and root of the heap over ``key``, largest on top, in the given order."""
    left, right, spine = [-1] * len(key), [-1] * len(key), []
    for i, k in enumerate(key):
        below = -1
        while spine and key[spine[-1]] < k:
            below = spine.pop()
        left[i] = below
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return left, right, spine[0]


class Best:
    """The k best documents so far: highest score, then lowest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.void = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def late(self, ids: np.ndarray, void: np.ndarray) -> np.ndarray:
        """Whether documents with these ids would lose a tie against all that are kept."""
        if len(self.score) < self.k:
            return np.zeros(len(ids), bool)
        return np.full(len(ids), not self.void[-1]) & (void | (ids >= self.id[-1])) | (self.void[-1] & void)

    def add(self, score: np.ndarray, ids: np.ndarray, void: np.ndarray) -> None:
        near = score >= self.least()
        score, ids, void = (np.concatenate(x) for x in ((self.score, score[near]), (self.id, ids[near]), (self.void, void[near])))
        order = np.lexsort((ids, void, -score))[: self.k]
        self.score, self.id, self.void = score[order], ids[order], void[order]


class Shard:
    """The treaps of one set of documents, given by ascending id (null ids last)."""

    def __init__(self, ids: np.ndarray, void: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int, words: int):
        order = np.lexsort((ids, void))
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        self.ids, self.void = ids[order], void[order]
        owner = np.repeat(np.arange(len(ids)), sizes)
        length = 100 - 50 + (50 * n * docs) // words
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[owner])
        by = np.lexsort((slot[owner], term))
        self.doc, self.impact = slot[owner][by], impact[by]
        term = term[by]
        self.terms, starts = np.unique(term, return_index=True)
        self.bounds = np.append(starts, len(term))
        self.left, self.right, self.roots = np.full(len(term), -1, np.int32), np.full(len(term), -1, np.int32), np.empty(len(self.terms), np.int32)
        key = (self.impact << 32) | ((self.doc * 0x9E3779B1) & 0xFFFFFFFF)
        for t, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            left, right, root = treap(key[a:b].tolist())
            for to, child in ((self.left, left), (self.right, right)):
                child = np.asarray(child, np.int32)
                to[a:b] = np.where(child < 0, -1, child + a)
            self.roots[t] = root + a

    def search(self, asked: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Put the documents that score among the best k by the terms ``asked`` into ``best``."""
        at = np.searchsorted(self.terms, asked)
        there = (at < len(self.terms)) & (np.take(self.terms, at, mode="clip") == asked) & (weights > 0) if len(self.terms) else np.zeros(len(asked), bool)
        at, weights = at[there], weights[there]
        if not len(at):
            return
        doc, impact = np.append(self.doc, -1), np.append(self.impact, 0)  # -1, no subtree, is the last place of both
        node, low, high = self.roots[at][None, :], np.zeros(1, np.int64), np.full(1, len(self.ids) - 1)
        while len(node):
            share = impact[node] * weights
            bound = share.sum(axis=1)
            open_ = (bound > best.least()) | ((bound == best.least()) & ~best.late(self.ids[low], self.void[low]))
            node, low, high, share, bound = node[open_], low[open_], high[open_], share[open_], bound[open_]
            if len(node) > WIDE:
                order = np.argsort(-bound, kind="stable")
                node, low, high, share = node[order], low[order], high[order], share[order]
            (node, rest), (low, low_rest), (high, high_rest), share = (node[:WIDE], node[WIDE:]), (low[:WIDE], low[WIDE:]), (high[:WIDE], high[WIDE:]), share[:WIDE]
            small = high - low < LEAF
            big = ~small
            split = doc[node[big, share[big].argmax(axis=1)]] if big.any() else np.empty(0, np.int64)
            self._score(at, weights, np.concatenate((low[small], split)), np.concatenate((high[small], split)), best)
            parts = [(rest, low_rest, high_rest)]
            for a, b in ((low[big], split - 1), (split + 1, high[big])):
                some = a <= b
                parts.append((self._within(node[big][some], a[some], b[some], doc), a[some], b[some]))
            node, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The highest nodes inside a part of a stretch, from those of the whole stretch (a subtree may reach beyond it)."""
        node = node.copy()
        row, column = np.nonzero(node >= 0)
        while len(row):
            now = node[row, column]
            before, after = doc[now] < low[row], doc[now] > high[row]
            out = before | after
            row, column, now, before = row[out], column[out], now[out], before[out]
            node[row, column] = now = np.where(before, self.right[now], self.left[now])
            row, column = row[now >= 0], column[now >= 0]
        return node

    def _score(self, at: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> None:
        """Score all documents of some stretches, which don't overlap."""
        total = np.zeros(len(self.ids), np.int64)
        for t, w in zip(at.tolist(), weights.tolist(), strict=True):
            a, b = self.bounds[t], self.bounds[t + 1]
            first, last = a + np.searchsorted(self.doc[a:b], low), a + np.searchsorted(self.doc[a:b], high, side="right")
            size = last - first
            here = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            total[self.doc[here]] += w * self.impact[here]  # a document once a term
        found = np.flatnonzero(total >= best.least())
        best.add(total[found], self.ids[found], self.void[found])


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms and counts of each document with any term; terms are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            rows: list[int] = []
            lengths, found, counts = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                n, seen = 0, Counter()
                for words in terms(text.as_py() or b""):
                    n += len(words)
                    seen.update(map(get, words))
                if n:
                    seen.pop(None, None)
                    rows.append(i)
                    lengths.append(n)
                    found.append(np.fromiter(seen.keys(), np.int32, len(seen)))
                    counts.append(np.fromiter(seen.values(), np.int64, len(seen)))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _searched(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, docs: int, words: int, k: int, shard: int) -> DataFrame:
    """q (the item's place), doc_id and score of each task's best documents."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]

        def take(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            flat = lambda c: table.column(c).combine_chunks()
            ids, listed = flat("doc_id"), flat("terms")
            sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
            index = Shard(
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), flat("n").to_numpy(zero_copy_only=False), sizes,
                listed.flatten().to_numpy(zero_copy_only=False), flat("counts").flatten().to_numpy(zero_copy_only=False), docs, words,
            )
            for asked, kept in zip(items, best, strict=True):
                index.search(asked, weights[asked], kept)

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= shard:
                take(parts)
                parts, size = [], 0
        if size:
            take(parts)
        found = [(q, kept) for q, kept in enumerate(best) if len(kept.score)]
        if found:
            q = np.repeat([q for q, _ in found], [len(b.score) for _, b in found])
            ids, void, score = (np.concatenate([getattr(b, c) for _, b in found]) for c in ("id", "void", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, mask=void), pa.array(score)], names=["q", "doc_id", "score"])

    return bounded(counted).mapInArrow(run, "q long, doc_id long, score long")


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """(item_id, terms) of all items, in lists of about ``limit`` characters of text."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = (row[1] or "").encode()
        block.append((row[0], sorted({w for words in terms(text) for w in words})))
        size += len(text) + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items, block_chars):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        counted = written(_counted(docs, vocabulary), "counted")
        total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block at most
            weights[term] = weight(total.docs, df)
        asked = [np.array([vocabulary[w] for w in words], np.int64) for _, words in block]
        best = _searched(counted, asked, weights, total.docs, total.words, k, shard)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        near = best.withColumn("salt", F.xxhash64("doc_id") % SALTS)
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("place") <= k)
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(block)], f"q long, item_id {kind}")
        found = found.union(near.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))  # names: one block
    return found


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_SPLIT} AS ws FROM documents) WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM d),
q AS (SELECT q, item_id, unnest(list_distinct(ws)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_SPLIT} AS ws FROM benchmark)),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT q.q, q.item_id, p.d, p.doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_words)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= {K}"""
