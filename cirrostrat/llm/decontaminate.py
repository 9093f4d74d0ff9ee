"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters is found in a text where some stretch is within ``k = floor(0.05 m)`` edits of the whole
item, both lower-cased with runs of anything but letters and digits as one space. Such a stretch shares at least
m + 1 - q - kq of the item's q-grams, all within k neighbouring diagonals. So:

1. all q-grams of a whole text are looked up among the items' q-grams;
2. hits are counted in overlapping diagonal bands of each item (bands of width w >= k + 1, each reaching k further);
3. bands that meet the bound are verified by banded alignment, neighbouring ones together.

With ``passage`` the same is done for passages of an item longer than that: stretches of ``passage`` characters, one
every ``STEP`` characters and one at its end, with the edits that their own length allows. So a document that leaves out
any part of an item is found if it has passage + STEP - 1 characters of it word for word, or one whole passage within its
edits. The query and the pipeline take ``PASSAGE``, the length of the shortest item of the given tables. An item's own
edits go before those of its passages.

Where the bound would be below one shared q-gram, k is lowered until it is one; items shorter than q characters are
looked for exactly, at word borders. The items are a query set: they are used in chunks of at most ``CHUNK_CHARS``
characters of text, one pass over the documents a chunk, and a chunk is what is broadcast.

Defined cases: null or empty texts and items match nothing; repeated rows repeat; items that are equal are all
reported; extra columns are ignored by ``leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import bounded, chunks

Q = 12
SHARE = 0.05
PASSAGE, STEP = 80, 20
CHUNK_CHARS = 4_000_000
#: Text positions whose hits are counted together, hits that are spread at a time, hits of an item for each position of a
#: slice from which on all its bands are candidates, and diagonals that are aligned together.
SLICE, ENTRIES, FULL, RUN = 1 << 16, 500_000, 4, 1 << 16
_TABLE_BITS = 22
#: Alignments that are gathered, and cells of their texts that are aligned together.
TASKS, CELLS = 20_000, 1 << 20
_OUTSIDE = np.uint32(0xFFFFFFFF)
_NOT_WORD = re.compile(r"[\W_]+")
_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


def normal(text: str | None) -> str:
    return _NOT_WORD.sub(" ", text.lower()).strip() if text else ""


def budget(m: int, share: float = SHARE, q: int = Q) -> int:
    """Edits allowed for an item of m characters."""
    return max(0, min(int(share * m), (m - q) // q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _grams(x: np.ndarray) -> np.ndarray:
    """Hashes of the Q values from each position on, from runs of 1, 2, 4 and 8 values."""
    run, power, size, out, done = x.astype(np.uint64) + np.uint64(1), _BASE, 1, None, 0
    n = max(0, len(x) - Q + 1)
    while size <= Q:
        if Q & size:
            out = run[Q - size :][:n].copy() if out is None else out + run[Q - done - size :][:n] * lift
            done += size
            lift = power if done == size else lift * power
        if size * 2 <= Q:
            run = run[:-size] * power + run[size:] if len(run) > size else run[:0]
        power, size = power * power, size * 2
    return out ^ (out >> np.uint64(31))


class Index:
    """q-gram index of a chunk of items (id, text)."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, passage: int = 0):
        if 0 < passage < Q:
            raise ValueError("a passage has at least Q characters")
        texts = [(i, normal(t)) for i, t in items]
        self.short = [(i, f" {t} ") for i, t in texts if 0 < len(t) < Q]
        self.items = [(i, t) for i, t in texts if len(t) >= Q]
        whole, self.wholes, self.passage = self.items, len(self.items), passage
        # passages follow the whole items; those of item i are numbered from base[i] to base[i + 1], each with its start
        starts = [[*range(0, len(t) - passage, STEP), len(t) - passage] if 0 < passage < len(t) else [] for _, t in whole]
        self.base = self.wholes + np.cumsum([0] + [len(s) for s in starts])
        self.begin = np.array([0] * self.wholes + [b for s in starts for b in s], dtype=np.int64)
        self.items = whole + [(i, t[b : b + passage]) for (i, t), s in zip(whole, starts, strict=True) for b in s]
        self.m = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.k = np.array([budget(len(t), share) for _, t in self.items], dtype=np.int64)
        self.need = self.m + 1 - Q - self.k * Q
        self.width = 1 << np.ceil(np.log2(np.maximum(self.k + 1, 8))).astype(np.int64) if self.items else self.m
        grams = [_grams(_codes(t)) for _, t in whole]
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.gram, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int64)
        self.item, self.offset = item[order], offset[order]
        # whether an item's last q-gram is in fewer items than its first
        held = [np.diff(self.first)[np.searchsorted(self.gram, g)] for g in grams]
        span = [(n, 0, len(held[n]) - 1) for n in range(self.wholes)] + [(n, b, b + passage - Q) for n, s in enumerate(starts) for b in s]
        self.backward = np.array([held[n][z] < held[n][a] for n, a, z in span], dtype=bool)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _in_passages(self, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, passage) for every passage that has the q-gram at ``offset`` of ``item``."""
        out, last = [], self.base[item + 1] - 1
        for back in range(-(-self.passage // STEP)):
            n = self.base[item] + offset // STEP - back
            ok = np.flatnonzero((n >= self.base[item]) & (n < last))
            out.append((ok, n[ok]))
        ok = np.flatnonzero(last >= self.base[item])
        hit, n = (np.concatenate(c) for c in zip(*out, (ok, last[ok]), strict=True))
        inside = offset[hit] - self.begin[n]
        ok = (inside >= 0) & (inside <= self.passage - Q)
        return hit[ok], n[ok]

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item id, edits) of every item found in the normalized ``texts``, with its fewest edits (of a passage only
        where the whole item isn't found)."""
        out: dict[tuple[int, int], tuple[bool, int]] = {}
        if self.short:
            for n, text in enumerate(texts):
                padded = f" {text} "
                for i, t in self.short:
                    if t in padded:
                        out[n, i] = False, 0
        gap = "\0" * max(Q, int(self.k.max(initial=0)) + 1)  # an alignment across it costs more than any item allows
        joined = gap.join(texts)
        x = _codes(joined)
        starts = np.cumsum([0] + [len(t) + len(gap) for t in texts])
        item, band = self._bands(x)
        if len(item):
            self._verify_runs(joined, x, starts, item, band, out)
        return [(n, i, e) for (n, i), (_, e) in sorted(out.items())]

    def _bands(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (item, band) that may hold an alignment: those with enough hits. Hits are counted slice by slice of the
        text, and a slice that is full of an item's q-grams (a repeated word, say) makes all its bands candidates uncounted."""
        g = _grams(x)
        at = np.flatnonzero(self.table[self._slot(g)]) if len(self.gram) else np.zeros(0, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        if not len(at):
            return none, none
        where = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[where] == g[at]
        at, where = at[ok], where[ok]
        keys, hits, full = [none], [none], []
        for start in range(0, len(x), SLICE):
            a, z = np.searchsorted(at, [start, start + SLICE])
            self._count(at[a:z], where[a:z], start, keys, hits, full)
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(hits), minlength=len(key)).astype(np.int64)
        found = np.unique(np.concatenate([key[total >= self.need[key >> 40]], *full]))
        return found >> 40, (found & ((1 << 40) - 1)) - (1 << 20)

    def _count(self, at: np.ndarray, where: np.ndarray, start: int, keys: list, hits: list, full: list) -> None:
        """Add one slice's hits: (key, number) by item and band, and the keys of items that fill it."""
        if not len(at):
            return
        gram, seen = np.unique(where, return_counts=True)
        counts = self.first[gram + 1] - self.first[gram]
        entry = np.repeat(self.first[gram], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        load = np.bincount(self.item[entry], weights=np.repeat(seen, counts), minlength=self.wholes)
        crowded = load > FULL * SLICE
        for i in np.flatnonzero(crowded).tolist():
            for n in (i, *range(int(self.base[i]), int(self.base[i + 1]))):
                low = (start - int(self.m[n])) // int(self.width[n]) - 1
                full.append((n << 40) + (1 << 20) + np.arange(low, (start + SLICE) // int(self.width[n]) + 1))
        counts = self.first[where + 1] - self.first[where]
        ends = np.cumsum(counts)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ENTRIES, side="right")))
            c, w = counts[low:high], where[low:high]
            entry = np.repeat(self.first[w], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            item, offset, place = self.item[entry], self.offset[entry], np.repeat(at[low:high], c)
            ok = ~crowded[item]
            item, offset, diagonal = item[ok], offset[ok], (place - self.offset[entry])[ok]
            if self.passage and len(self.items) > self.wholes:
                hit, part = self._in_passages(item, offset)
                item, diagonal = np.concatenate([item, part]), np.concatenate([diagonal, diagonal[hit] + self.begin[part]])
            band, into = np.divmod(diagonal, self.width[item])
            also = into < self.k[item]  # such a hit lies in the reach of the band before, too
            item, band = np.concatenate([item, item[also]]), np.concatenate([band, band[also] - 1])
            # a band's hits come from one stretch of at most m + width + k characters, which may touch two texts: gaps never match
            key, number = np.unique((item << 40) + band + (1 << 20), return_counts=True)
            keys.append(key)
            hits.append(number)
            low = high

    def _verify_runs(self, joined: str, x: np.ndarray, starts: np.ndarray, item: np.ndarray, band: np.ndarray, out: dict) -> None:
        """Align each item along its runs of neighbouring bands, many at a time. Items go before passages; a passage is left
        out in texts that have its whole item, and nothing is looked for where it was found without an edit."""
        change = np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1)])
        change |= np.concatenate([[False], band[1:] * self.width[item[1:]] // RUN != band[:-1] * self.width[item[:-1]] // RUN])
        first = np.flatnonzero(change)
        todo: list[tuple[int, int, int, int, int]] = []  # text, item, its first and last diagonal, the text's beginning
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(item)], strict=True):
            i = int(item[a])
            name, text = self.items[i]
            k, m, width, is_part = int(self.k[i]), int(self.m[i]), int(self.width[i]), i >= self.wholes
            if todo and (len(todo) >= TASKS or is_part != (todo[0][1] >= self.wholes)):
                self._align(todo, x, starts, out)
                todo = []
            low, high = int(band[a]) * width, int(band[z - 1] + 1) * width + k  # diagonals of the run
            texts = range(max(0, int(np.searchsorted(starts, low - k, side="right")) - 1), max(1, int(np.searchsorted(starts, high + k + m, side="left"))))
            for n in texts:
                if n >= len(starts) - 1 or self._done(out, n, i):
                    continue
                begin, end = int(starts[n]), int(starts[n + 1])
                if joined.find(text, max(begin, low), min(end, high + m)) >= 0:
                    out[n, name] = is_part, 0
                    continue
                a0, a1 = max(low - k, begin - m - k), min(high + k, end + k)
                if a1 > a0:
                    todo.append((n, i, a0 - begin, a1 - begin, begin))
        if todo:
            self._align(todo, x, starts, out)

    def _done(self, out: dict, n: int, i: int) -> bool:
        """Whether nothing better can be found for an item in a text."""
        return out.get((n, self.items[i][0]), (True, int(self.m[i]) + 1)) <= ((True, 0) if i >= self.wholes else (False, 0))

    def _align(self, todo: list[tuple[int, int, int, int, int]], x: np.ndarray, starts: np.ndarray, out: dict) -> None:
        """Align all of ``todo``, those of equal length and budget together, from the end whose q-grams fewer items have:
        items that only begin alike are told apart within a few characters."""
        todo = sorted((t for t in todo if not self._done(out, t[0], t[1])), key=lambda t: (int(self.m[t[1]]), int(self.k[t[1]]), t[3] - t[2]))
        start = 0
        while start < len(todo):
            m, k, stop = int(self.m[todo[start][1]]), int(self.k[todo[start][1]]), start
            while stop < len(todo) and (int(self.m[todo[stop][1]]), int(self.k[todo[stop][1]])) == (m, k) and (stop == start or (stop + 1 - start) * (todo[stop][3] - todo[stop][2] + m) <= CELLS):
                stop += 1
            part = todo[start:stop]
            wide = part[-1][3] - part[-1][2]
            items, texts = np.empty((len(part), m), np.uint32), np.full((len(part), wide + m), _OUTSIDE, np.uint32)
            size, room = np.empty(len(part), np.int64), np.empty((len(part), 2), np.int64)
            for r, (n, i, a0, a1, begin) in enumerate(part):
                code, text, low = self.codes(i), x[max(0, begin) : int(starts[n + 1])], a0
                if self.backward[i]:
                    code, text, low = code[::-1], text[::-1], len(text) - m - (a1 - 1)
                items[r], size[r], room[r] = code, a1 - a0, (-low, len(text) - low)
                a, z = max(0, low), min(len(text), low + a1 - a0 + m)
                if z > a:
                    texts[r, a - low : z - low] = text[a:z]
            for (n, i, *_), edits in zip(part, align_many(items, texts, size, room, k).tolist(), strict=True):
                found = (i >= self.wholes, edits)
                if edits <= k and found < out.get((n, self.items[i][0]), (True, m + 1)):
                    out[n, self.items[i][0]] = found
            start = stop

    def codes(self, i: int) -> np.ndarray:
        return _codes(self.items[i][1])


def align_many(items: np.ndarray, texts: np.ndarray, size: np.ndarray, room: np.ndarray, k: int) -> np.ndarray:
    """Fewest edits (above k: any such number) of each row's item along its first ``size`` diagonals of its stretch of text,
    whose characters the text has from ``room[:, 0]`` up to ``room[:, 1]``. Rows that have spent their edits are left."""
    rows, m = items.shape
    d = np.arange(texts.shape[1] - m, dtype=np.int32)
    far, out, at = np.int32(k + 1), np.full(rows, k + 1, np.int32), np.arange(rows)
    shut = d[None, :] >= size[:, None]
    row = np.where(shut | (d < room[:, :1]) | (d > room[:, 1:]), far, np.int32(0))  # an alignment may start on any diagonal
    for i in range(m):
        seen = texts[:, i : i + len(d)]  # text characters that this row's diagonal step takes
        step = row + (seen != items[:, i : i + 1])
        step[seen == _OUTSIDE] = far
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # the item's character is missing in the text
        row = np.minimum(np.minimum(step, far), np.minimum.accumulate(step - d, axis=1) + d)  # further text characters
        row[shut] = far
        if i % 4 == 3:
            live = row.min(axis=1) <= k
            if not live.all() and live.sum() < 0.8 * len(live):
                items, texts, shut, row, at = items[live], texts[live], shut[live], row[live], at[live]
                if not len(at):
                    return out
    out[at] = row.min(axis=1)
    return out


def align(item: np.ndarray, text: np.ndarray, low: int, diagonals: int, k: int) -> int | None:
    """Fewest edits, if at most k, of an alignment of the whole ``item`` along the diagonals low, ..., low + diagonals - 1 of
    ``text``; positions outside the text cost more than k."""
    d = np.arange(diagonals, dtype=np.int32)
    far = np.int32(k + 1)
    place = low + d
    row = np.where((place >= 0) & (place <= len(text)), np.int32(0), far)  # an alignment may start on any diagonal
    padded = np.full(diagonals + len(item), 0xFFFFFFFF, dtype=np.uint32)  # text positions low, ..., those outside match nothing
    a, z = max(0, low), min(len(text), low + len(padded))
    if z > a:
        padded[a - low : z - low] = text[a:z]
    for i, c in enumerate(item.tolist()):
        seen = padded[i : i + diagonals]  # text characters that this row's diagonal step takes
        step = row + (seen != c)
        step[seen == 0xFFFFFFFF] = far
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # the item's character is missing in the text
        step[-1] = min(step[-1], far)
        row = np.minimum(np.minimum(step, far), np.minimum.accumulate(step - d) + d)  # further text characters
        if row.min() > k:
            return None
    return int(row.min())


def _item_chunks(benchmark: DataFrame, limit: int):
    part, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if part and size + len(r[1]) > limit:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, chunk_chars: int = CHUNK_CHARS, passage: int = 0) -> DataFrame:
    """doc_id, item_id and edits (the fewest) of every benchmark item (item_id, text) found in ``docs`` (doc_id, text); with
    ``passage``, also of items of which a passage is found."""
    spark, kinds, out = docs.sparkSession, "doc_id long, item_id long, edits int", None
    for part in _item_chunks(benchmark, chunk_chars):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            index = None
            for batch in batches:
                index = index or Index(shared.value, share, passage)
                ids, texts = batch.column(0), [normal(t) for t in batch.column(1).to_pylist()]
                for a, b in chunks(texts):
                    if found := index.find(texts[a:b]):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + n for n, _, _ in found])), pa.array([i for _, i, _ in found], pa.int64()), pa.array([e for *_, e in found], pa.int32())], names=["doc_id", "item_id", "edits"])

        one = bounded(docs).select("doc_id", "text").mapInArrow(run, kinds)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], kinds) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, chunk_chars: int = CHUNK_CHARS, passage: int = 0) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item (with ``passage``, no passage of one) is found, as they are."""
    at = docs.columns.index("text")
    for part in _item_chunks(benchmark, chunk_chars):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            index = None
            for batch in batches:
                index = index or Index(shared.value, share, passage)
                texts = [normal(t) for t in batch.column(at).to_pylist()]
                keep = np.ones(len(texts), dtype=bool)
                for a, b in chunks(texts):
                    keep[[a + n for n, _, _ in index.find(texts[a:b])]] = False
                yield batch.filter(pa.array(keep))

        docs = bounded(docs).mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passage=PASSAGE)
