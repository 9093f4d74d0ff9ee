"""SimHash near-duplicates by segment-popcount embedding.

1. Fingerprints: majority bits of the XXH64 (seed 42) of a text's word shingles; one pass, Arrow and numpy.
2. Distinct fingerprints are cut into ``SEGMENTS`` two-bit segments; their popcounts embed them in a lattice where the
   Manhattan distance never exceeds the Hamming distance. Coordinates form six groups. Points within Manhattan distance
   3 agree wholly on three groups at least, so each fingerprint enters the twenty grid cells that its triples of groups
   name, and a pair is looked at in the cell of its first common triple only. The join condition bounds the Manhattan
   distance and then verifies the Hamming distance exactly.
3. Cells above ``CELL_ROWS`` points are joined block by block instead, and a block pair gives a spanning forest of its
   links, so no group of near copies emits all its pairs.
4. Components by alternating large-star and small-star steps over written tables.

Defined cases: null, empty and white-space texts have fingerprint zero and link like any other; null doc_ids keep
their fingerprint and component, and never name a component unless all its ids are null; repeated rows share a
fingerprint; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import bounded, free, written
from cirrostrat.llm.graph import components

SEED = 42
MAX_BITS = 3
SEGMENTS = 32
GROUPS = 6
CELL_ROWS = 4096
#: Segments (numbered from the least significant bits) of each group.
MEMBERS = [list(range(g * SEGMENTS // GROUPS, (g + 1) * SEGMENTS // GROUPS)) for g in range(GROUPS)]
TRIPLES = list(combinations(range(GROUPS), GROUPS - MAX_BITS))

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends[: len(words) - shingle + 1] - np.array([len(w) + 1 for w in words[: len(words) - shingle + 1]])).tolist()
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]), dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes``."""
    octets = np.ascontiguousarray(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(octets)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.int64())], names=["doc_id", "tie", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp of every document."""
    return bounded(docs).select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(_fingerprints, "doc_id long, tie long, fp long")


def _popcounts(fp):
    """Two bits per segment: the number of set bits among the segment's two (0, 1 or 2)."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _mask(groups) -> int:
    mask = sum(3 << (2 * s) for g in groups for s in MEMBERS[g])
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _differs(a, b):
    """For the lattice points a and b (two bits a coordinate): their Manhattan distance, with |2-0| = 2."""
    low, x = F.lit(0x5555555555555555), a.bitwiseXOR(b)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(low)
    odd = x.bitwiseAND(low)
    # codes 0, 1, 2: xor 1 (0-1) and 3 (1-2) mean one apart, xor 2 (0-2) means two apart
    return F.bit_count(odd) + F.lit(2) * F.bit_count(high.bitwiseAND(F.bitwise_not(odd)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``max_bits`` (3 or fewer) apart; from cells above CELL_ROWS a
    spanning forest of the cell's links."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the grid is built for at most three bits")
    points = fps.select("fp").withColumn("p", _popcounts(F.col("fp")))
    cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col("p").bitwiseAND(F.lit(_mask(t))).alias("c")) for i, t in enumerate(TRIPLES)])
    keyed = points.select("fp", "p", F.inline(cells))
    full = keyed.groupBy("t", "c").count().where(F.col("count") > CELL_ROWS)
    full = written(full, "cells")
    crowded = full.limit(1).count() > 0
    some = keyed.join(full, ["t", "c"], "left_anti") if crowded else keyed
    a, b = some.select("t", "c", F.col("fp").alias("a"), F.col("p").alias("pa")), some.select("t", "c", F.col("fp").alias("b"), F.col("p").alias("pb"))
    same = [F.col("pa").bitwiseXOR(F.col("pb")).bitwiseAND(F.lit(_mask([g]))) == 0 for g in range(GROUPS)]
    first = F.lit(False)
    for i in range(len(TRIPLES) - 1, -1, -1):
        first = F.when(same[TRIPLES[i][0]] & same[TRIPLES[i][1]] & same[TRIPLES[i][2]], F.col("a_t") == i).otherwise(first)
    a, b = a.withColumnRenamed("t", "a_t").withColumnRenamed("c", "a_c"), b.withColumnRenamed("t", "b_t").withColumnRenamed("c", "b_c")
    near = (_differs(F.col("pa"), F.col("pb")) <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    found = a.join(b, (F.col("a_t") == F.col("b_t")) & (F.col("a_c") == F.col("b_c")) & (F.col("a") < F.col("b")) & near & first).select("a", "b")
    return found.unionByName(_crowded(keyed, full, max_bits)) if crowded else found


def _crowded(keyed: DataFrame, full: DataFrame, max_bits: int) -> DataFrame:
    """Spanning forests of the links in full cells, by pairs of blocks of about CELL_ROWS points."""
    rows = keyed.join(full.withColumn("n", F.ceil(F.col("count") / CELL_ROWS).cast("int")), ["t", "c"])
    rows = rows.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    rows = rows.select("t", "c", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    rows = rows.select("t", "c", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "fp")

    def forest(table: pa.Table) -> pa.Table:
        fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("i").to_numpy()
        order = np.lexsort((fp, side))
        fp, side = fp[order], side[order]
        parent = list(range(len(fp)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(fp)):
            start = x + 1 if side[0] == side[-1] else int(np.searchsorted(side, side[x], side="right"))
            for y in (start + np.flatnonzero(np.bitwise_count(fp[start:] ^ fp[x]) <= max_bits)).tolist():
                r, s = root(x), root(y)
                if r != s:
                    parent[s] = r
                    out.append((x, y))
        pairs = fp.view(np.int64)[np.array(out, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return rows.groupBy("t", "c", "lo", "hi").applyInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, tie, fp, component (its smallest fingerprint) and component_id (smallest doc_id reachable) of every
    document."""
    marked = written(fingerprints(docs), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    joined = components(links(fps, max_bits), "a", "b")
    final = fps.join(joined, fps["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    tops = final.groupBy("component").agg(F.min("low").alias("component_id"))
    return marked.join(final.join(tops, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "tie", "fp", "component", "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id (nulls last) of their group of near-duplicates, one a group."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")
    kept = near_duplicates(docs, max_bits).groupBy("component").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__tie"))
    kept = written(kept, "representatives")
    tie, own_id, own_tie = (free(n, docs.columns) for n in ("__hash", "__id", "__tie"))
    rows, kept = docs.withColumn(tie, F.xxhash64("text")), kept.toDF(own_id, own_tie)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(tie) == F.col(own_tie)), "left_semi")
    return rows.dropDuplicates(["doc_id", tie]).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
