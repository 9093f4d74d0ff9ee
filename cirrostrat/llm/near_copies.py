"""Near copies at a chosen similarity: the SimHash operator's wide form, over five-word shingles, Jaccard 0.8 or more.

At similarity 0.8 two 64-bit fingerprints differ in ten to twelve bits, and no grid over popcounts separates so wide a
radius from chance. So the operator's grid join (three bits) gives the close copies, and cells of shared shingles give
the others; every link is checked on the whole shingle sets.

1. Each text becomes its set of word shingles (XXH64, seed 42) and the fingerprint of that set. Shingles have one order
   for all texts: by how often a sample of documents has them (rare first), then by hash. The sample moves only the
   cost, never the result.
2. Segment-popcount grid: fingerprints within three bits are the first pairs (of equal fingerprints, each with one).
3. Prefix lemma: two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of both. Prefix shingles
   that two distinct sets share are cells; a pair must also pass the bounds on sizes and on what can follow its shingle.
   Each set is first paired with centres of its cells (``CENTRES`` orders): with the one it shares most cells with, then
   with the others, as far as links found before don't connect the two. So large groups of near copies grow together
   without all their pairs. The last round looks at all pairs of a cell that are in different components still; in cells
   above ``CELL_SETS`` block by block, where a pair of blocks gives a spanning forest of its links and no other pair.
4. Every link is checked on the whole shingle sets, so none below the similarity links. Components are those of the
   links. A pair of 0.8 or more is missed only by chance of its hashes: equal 64-bit ones, or fingerprints of two sets of
   ``FEW`` shingles or more that differ in over ``RADIUS`` bits, which are left out before the check (one pair in ten
   million or fewer at 0.8, by the binomial distribution of 64 bits; the higher the similarity, the fewer; ``radius`` None
   leaves none out).

Defined cases: a text of at most five words is one shingle; null, empty and white-space texts are copies of each other;
null doc_ids come last in their group; repeated rows are one; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.llm import simhash
from cirrostrat.llm.common import bounded, free, written
from cirrostrat.llm.graph import components

SEED = 42
SHINGLE = 5
#: The least similarity is PART / WHOLE.
PART, WHOLE = 4, 5
#: Documents whose shingles are counted for the order, and the most shingles that are broadcast with their counts.
SAMPLE_DOCS, MOST_COMMON = 20_000, 100_000
CENTRES = 6
#: Bits by which the fingerprints of similar sets may differ: 0.8 makes ten to twelve likely, more than 28 all but
#: impossible from FEW shingles on.
RADIUS, FEW = 28, 32
#: Sets of a cell whose pairs are joined as rows, and sets of a block in larger cells.
CELL_SETS, BLOCK_SETS = 256, 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-SHINGLE] + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def _key(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate(arrays) if arrays else []))


def _sets(batches):
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([_longs([_key(h) for h in found]), _lists(found)], names=["key", "shingles"])


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of about SAMPLE_DOCS documents has more than once, sorted, and their counts there."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = bounded(some).mapInArrow(_sets, "key long, shingles array<long>").select(F.explode("shingles").alias("token")).groupBy("token").count()
    rows = counts.where("count > 1").orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("count").to_numpy()[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), key (a hash of its shingle set), n (the set's size), fp and prefix of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs))

    def run(batches):
        tokens, counts = shared.value
        for batch in batches:
            keys, sizes, firsts, fps = [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py())
                at = np.minimum(np.searchsorted(tokens, h), max(0, len(tokens) - 1))
                often = np.where(tokens[at] == h, counts[at], 0) if len(tokens) else np.zeros(len(h), dtype=np.int64)
                keys.append(_key(h))
                sizes.append(len(h))
                fps.append(simhash.majority(h))
                firsts.append(h[np.argsort(often, kind="stable")[: prefix_length(len(h))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _longs(keys), pa.array(sizes, pa.int32()), _longs(fps), _lists(firsts)], names=["doc_id", "tie", "key", "n", "fp", "prefix"])

    return bounded(docs).select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, key long, n int, fp long, prefix array<long>")


def _possible(n, pos, m, other):
    """Whether sets of n and m shingles may be similar if their first common shingle stands at pos and other."""
    inter = F.least(n - pos, m - other)
    return (WHOLE * F.least(n, m) >= PART * F.greatest(n, m)) & ((PART + WHOLE) * inter >= PART * (n + m))


class _Links:
    """Checked links so far, their components, and the shingle sets that checks have needed."""

    def __init__(self, docs: DataFrame, marked: DataFrame):
        self.docs, self.marked, self.links, self.joined, self.sets = docs, marked, None, None, None

    def prepare(self, keys: DataFrame) -> None:
        """Shingle sets of those of ``keys`` that aren't known yet: one pass over the texts."""
        keys = keys.distinct() if self.sets is None else keys.distinct().join(self.sets, "key", "left_anti")
        ties = self.marked.select("key", "tie").join(keys, "key", "left_semi").groupBy("key").agg(F.min("tie").alias("tie")).select(F.col("tie").alias("__tie"))
        texts = self.docs.select("text", F.xxhash64("text").alias("tie")).join(ties, F.col("tie") == F.col("__tie"), "left_semi").dropDuplicates(["tie"]).select("text")
        sets = written(bounded(texts).mapInArrow(_sets, "key long, shingles array<long>"), "shingles")
        self.sets = sets if self.sets is None else self.sets.union(sets)

    def between(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose sets are in different components so far."""
        if self.joined is None:
            return pairs
        top = lambda c: self.joined.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_top"))
        both = pairs.join(top("a"), F.col("a") == F.col("a_node"), "left").join(top("b"), F.col("b") == F.col("b_node"), "left")
        return both.where(F.coalesce("a_top", "a") != F.coalesce("b_top", "b")).select(*pairs.columns)

    def check(self, pairs: DataFrame) -> None:
        """Add those of ``pairs`` (a, b) whose sets have the least similarity."""
        both = pairs.join(self.sets.toDF("a", "sa"), "a").join(self.sets.toDF("b", "sb"), "b")
        inter = F.size(F.array_intersect("sa", "sb"))
        self.add(both.where((PART + WHOLE) * inter >= PART * (F.size("sa") + F.size("sb"))).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        """Add checked links (a, b)."""
        good = written(links, "links")
        self.links = good if self.links is None else self.links.union(good)
        self.joined = written(components(self.links, "a", "b"), "joined")


def _apart(pairs: DataFrame, keys: DataFrame, radius: int | None) -> DataFrame:
    """``pairs`` (a, b, ...) without those whose fingerprints are more than ``radius`` bits apart (None: all of them); sets of
    few shingles always stay."""
    if radius is None:
        return pairs
    own = lambda c: keys.select(F.col("key").alias(f"{c}_key"), F.col("fp").alias(f"{c}_fp"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(own("a"), F.col("a") == F.col("a_key")).join(own("b"), F.col("b") == F.col("b_key"))
    few = F.least("a_n", "b_n") < FEW
    return both.where(few | (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= radius)).select(*pairs.columns)


def _grid_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys by the segment-popcount grid: fingerprints within three bits, and equal ones."""
    low = written(keys.groupBy("fp").agg(F.min("key").alias("low")), "low")
    equal = keys.join(low, "fp").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    near = simhash.links(low.select("fp")).toDF("fa", "fb")
    near = near.join(low.toDF("fa", "a"), "fa").join(low.toDF("fb", "b"), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(near).distinct()


def links(docs: DataFrame, marked: DataFrame, radius: int | None = RADIUS) -> DataFrame:
    """Components (node, component) of all pairs of keys of the least similarity; sets without a near copy aren't listed."""
    known = _Links(docs, marked)
    one = written(marked.select("key", "n", "fp", "prefix").dropDuplicates(["key"]), "keys")
    keys = one.select("key", "n", "fp")
    grid = written(_apart(_grid_pairs(keys), keys, radius), "grid")
    rows = one.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    several = F.count("*").over(Window.partitionBy("token"))
    cells = written(rows.withColumn("several", several).where("several > 1").drop("several"), "cells")
    orders = [F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key", "n", "pos")).alias(f"c{k}") for k in range(CENTRES)]
    centres = cells.groupBy("token").agg(*orders).select("token", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"c{k}.key").alias("centre"), F.col(f"c{k}.n").alias("m"), F.col(f"c{k}.pos").alias("other")) for k in range(CENTRES)]))).alias("c")).select("token", "c.*")
    stars = cells.join(centres, "token").where((F.col("key") != F.col("centre")) & _possible(F.col("n"), F.col("pos"), F.col("m"), F.col("other")))
    stars = written(_apart(stars.groupBy(F.col("key").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared")), keys, radius), "stars")
    known.prepare(grid.select(F.col("a").alias("key")).union(grid.select("b")).union(stars.select("a")).union(stars.select("b")))
    known.check(grid)
    best = known.between(stars).groupBy("a").agg(F.max(F.struct("shared", F.xxhash64("b", F.lit(SEED)), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    known.check(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known.check(known.between(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    cells = written(cells.join(known.joined, cells["key"] == known.joined["node"], "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("component")), "cells")
    # of each cell with several components, the largest one's sets are paired with the others only
    largest = cells.groupBy("token", "component").count().groupBy("token").agg(F.max(F.struct("count", "component")).alias("c"), F.count("*").alias("several"), F.sum("count").alias("size"))
    mixed = written(cells.join(largest.where("several > 1").select("token", "size", F.col("c.component").alias("main")), "token"), "mixed")
    some = mixed.where(F.col("size") <= CELL_SETS)
    a = some.where("component <> main").select("token", *[F.col(c).alias(f"a_{c}") for c in ("key", "n", "pos", "component")])
    b = some.select(F.col("token").alias("b_token"), "main", *[F.col(c).alias(f"b_{c}") for c in ("key", "n", "pos", "component")])
    once = (F.col("b_component") == F.col("main")) | (F.col("a_key") < F.col("b_key"))
    near = _possible(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"))
    rest = a.join(b, (F.col("token") == F.col("b_token")) & (F.col("a_component") != F.col("b_component")) & once & near)
    rest = rest.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(grid)
    rest = written(_apart(rest.join(seen, ["a", "b"], "left_anti"), keys, radius), "pairs")
    crowd = mixed.where(F.col("size") > CELL_SETS).groupBy("main", "key").agg(F.max(F.col("component") == F.col("main")).alias("inside"))
    crowd = written(crowd, "crowd")
    known.prepare(rest.select(F.col("a").alias("key")).union(rest.select("b")).union(crowd.select("key")))
    known.check(rest)
    if crowd.limit(1).count():
        known.add(_crowded(crowd, known.sets))
    return known.joined


def _crowded(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the large cells: of each component's cells (``main``) the sets outside it are compared with those
    inside and with each other, block by block."""
    blocks = crowd.groupBy("main").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / BLOCK_SETS)).cast("int").alias(n) for c, n in ((F.col("inside"), "ins"), (~F.col("inside"), "outs"))])
    rows = crowd.join(blocks, "main").join(sets, "key")
    block = lambda n: F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col(n)).cast("int")
    every = lambda n, *cols: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.struct(*[(c(j) if callable(c) else c).alias(k) for k, c in zip(("within", "x", "y", "side"), cols, strict=True)]))
    ins = every("outs", F.lit(False), lambda j: j, block("ins"), F.lit(1))
    outs = F.concat(every("ins", F.lit(False), block("outs"), lambda j: j, F.lit(0)), every("outs", F.lit(True), lambda j: F.least(j, block("outs")), lambda j: F.greatest(j, block("outs")), block("outs")))
    rows = rows.select("main", "key", "shingles", F.inline(F.when(F.col("inside"), ins).otherwise(outs)))

    def forest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("key", "ascending")])
        key, side, own = table.column("key").to_numpy(), table.column("side").to_numpy(), [np.array(s, dtype=np.int64) for s in table.column("shingles").to_pylist()]
        cut, within = int(np.searchsorted(side, side[0], side="right")), table.column("within")[0].as_py()
        first, second = own[:cut], own[cut:] if cut < len(own) else own[:cut] if within else []
        shift, parent, out = (cut if cut < len(own) else 0), list(range(len(own))), []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if not within:  # the sets inside are in one component already
            parent[cut:] = [cut] * (len(own) - cut)
        for x, y in np.argwhere(_similar(first, second)).tolist():
            r, s = root(x), root(y + shift)
            if r != s:
                parent[s] = r
                out.append((x, y + shift))
        pairs = key[np.array(out, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return rows.groupBy("main", "within", "x", "y").applyInArrow(forest, "a long, b long")


def _similar(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``first`` and each of ``second`` (distinct values) have the least similarity."""
    if not first or not second:
        return np.zeros((len(first), len(second)), dtype=bool)
    both = np.intersect1d(np.concatenate(first), np.concatenate(second))
    inter = np.zeros((len(first), len(second)), dtype=np.float32)
    for start in range(0, len(both), 4096):
        part = both[start : start + 4096]
        left, right = (np.zeros((len(x), len(part)), dtype=np.float32) for x in (first, second))
        for matrix, sets in ((left, first), (right, second)):
            for n, s in enumerate(sets):
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                matrix[n, at[part[at] == s]] = 1
        inter += left @ right.T
    sizes = np.array([len(s) for s in first])[:, None] + np.array([len(s) for s in second])[None, :]
    return (PART + WHOLE) * inter.astype(np.int64) >= PART * sizes


def near_copies(docs: DataFrame, radius: int | None = RADIUS) -> DataFrame:
    """doc_id, tie and component (the smallest key of its shingle sets) of every document. ``radius`` None looks at the sets
    of every pair, however far apart their fingerprints are."""
    marked = written(prefixes(docs), "marked")
    joined = links(docs, marked, radius)
    return marked.join(joined, marked["key"] == joined["node"], "left").select("doc_id", "tie", F.coalesce("component", "key").alias("component"))


def representatives(docs: DataFrame, radius: int | None = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id (nulls last) of their group of near copies, one a group."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")
    kept = near_copies(docs, radius).groupBy("component").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__tie"))
    kept = written(kept, "representatives")
    tie, own_id, own_tie = (free(n, docs.columns) for n in ("__hash", "__id", "__tie"))
    rows, kept = docs.withColumn(tie, F.xxhash64("text")), kept.toDF(own_id, own_tie)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(tie) == F.col(own_tie)), "left_semi")
    return rows.dropDuplicates(["doc_id", tie]).select(*docs.columns)
