"""Exact top-k by Hamming distance with incremental multi-index hashing.

Binary codes (the signs of the dimensions: a long for up to 64, else an array of longs, 64 bits each) are cut into m segments
of log2(number of codes) bits or a little less, so a segment value is shared by a few codes however many there are; the index
has a row per distinct code and segment. Round
r looks up, for the queries still open, every segment value at exactly r flipped bits. After it, all codes within
m(r + 1) - 1 bits have been seen, since such a code has a segment within r. A query closes when its k-th verified
distance is at most that bound; the others go on. Codes are searched once however many rows share them, for each code
the k smallest ids suffice.

Ties go to the smaller id; a query row is itself part of the table. Defined cases: null embeddings or null entries have
no code and take no part; shorter vectors are padded by zero bits, vectors longer than the chosen width (``width`` finds the table's) are an error; null ids take no part; repeated rows each count;
fewer than k rows give what there is; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.llm.common import written

K = 10
BITS = 64
#: Segments of 64 bits of a code: two for some 2**32 codes, eight for few.
LEAST_SEGMENTS, MOST_SEGMENTS = 2, 8


def width(embeddings: DataFrame, column: str = "embedding") -> int:
    """Bits of the table's codes: those of its longest vector, in words of 64."""
    return BITS * max(1, ceil((embeddings.agg(F.max(F.size(column))).first()[0] or 0) / BITS))


def code(embedding: Column, bits: int = BITS) -> Column:
    """``bits`` sign bits (a multiple of 64): bit i % 64 of word i div 64 is set where the i-th value is above zero. A long
    for one word, else an array of longs."""
    value = lambda i: F.lit(1 << i if i < 63 else -(1 << 63))
    longer = F.raise_error(F.lit(f"a code has {bits} bits; an embedding has more values"))
    if bits > BITS:
        places = F.array(*[value(i).cast("long") for i in range(BITS)])
        signs = lambda w: F.zip_with(F.slice(embedding, BITS * w + 1, BITS), places, lambda x, p: F.when(x > 0, p).otherwise(F.lit(0).cast("long")))
        out = F.array(*[F.aggregate(signs(w), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)) for w in range(bits // BITS)])
        longer = longer.cast("array<long>")
    else:
        bit = lambda i: F.when(F.coalesce(F.try_element_at(embedding, F.lit(i + 1)), F.lit(0.0)) > 0, value(i)).otherwise(F.lit(0))
        out, longer = bit(0).cast("long"), longer.cast("long")
        for i in range(1, BITS):
            out = out.bitwiseOR(bit(i).cast("long"))
    return F.when(F.size(embedding) > bits, longer).when(embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull()), out)


def segments(n_codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of each segment for that many distinct codes."""
    words = bits // BITS
    m = min(MOST_SEGMENTS * words, max(LEAST_SEGMENTS * words, ceil(bits / max(1.0, log2(max(2, n_codes))))))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, z - a) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _cut(c: str, parts: list[tuple[int, int]], bits: int) -> Column:
    """Rows seg, width and val of a code's segments."""

    def val(a: int, w: int) -> Column:
        word = lambda i: F.col(c) if bits == BITS else F.element_at(c, i + 1)
        low = F.shiftrightunsigned(word(a // BITS), a % BITS)
        if a % BITS + w > BITS:
            low = low.bitwiseOR(F.shiftleft(word(a // BITS + 1), BITS - a % BITS))
        return low.bitwiseAND(F.lit((1 << w) - 1))

    return F.inline(F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(w).alias("width"), val(a, w).alias("val")) for i, (a, w) in enumerate(parts)]))


def _distance(a: str, b: str, bits: int) -> Column:
    if bits == BITS:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _probes(open_: DataFrame, parts: list[tuple[int, int]], radius: int, bits: int) -> DataFrame:
    """q, most, p_seg and p_val of every segment value at exactly ``radius`` flipped bits: bits are flipped one after the
    other, each above the last."""
    out = open_.select("q", "most", _cut("q", parts, bits)).withColumn("next", F.lit(0))
    for _ in range(radius):
        flipped = out.where("next < width").select("q", "most", "seg", "width", "val", F.explode(F.sequence(F.col("next"), F.col("width") - 1)).alias("bit"))
        out = flipped.select("q", "most", "seg", "width", F.expr("val ^ shiftleft(1L, bit)").alias("val"), (F.col("bit") + 1).alias("next"))
    return out.select("q", "most", F.col("seg").alias("p_seg"), F.col("val").alias("p_val"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, id and distance of the k rows of ``codes`` (id, code) nearest to each row of ``queries``
    (query_id, code); the codes of both are of one width."""
    if k < 1:
        raise ValueError("k must be positive")
    bits = BITS if dict(codes.dtypes)["code"] == "bigint" else BITS * (codes.agg(F.max(F.size("code"))).first()[0] or 2)
    firsts = codes.where("id is not null and code is not null")
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("n") <= k)  # a hot code's rows in 64 parts first
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    table = written(firsts.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    parts = segments(table.count(), bits)
    index = written(table.select("code", F.size("ids").alias("n"), _cut("code", parts, bits)).drop("width"), "index")
    asked = written(queries.where("query_id is not null and code is not null").select(F.col("code").alias("q"), F.lit(bits).alias("most")).distinct(), "asked")
    open_, seen, best = asked, None, []
    widest = max(w for _, w in parts)
    for radius in range(widest + 1):
        probes = _probes(open_, parts, radius, bits)
        # probes come from few rows but are many: Spark would take them for small enough to broadcast. What lies beyond
        # the k-th distance found so far can't count any more
        d = _distance("q", "code", bits)
        hits = probes.hint("merge").join(index.hint("merge"), (F.col("p_seg") == F.col("seg")) & (F.col("p_val") == F.col("val")) & (d <= F.col("most")))
        hits = hits.select("q", "code", "n", d.alias("d")).distinct()
        seen = hits if seen is None else seen.join(open_, "q", "left_semi").union(hits).distinct()
        # of a query's codes keep those that can still be among its k nearest rows
        ahead = F.sum("n").over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1))
        seen = written(seen.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < k).drop("ahead"), "seen")
        bound = len(parts) * (radius + 1) - 1
        covered = seen.where(F.col("d") <= bound).groupBy("q").agg(F.sum("n").alias("rows")).where(F.col("rows") >= k).select("q")
        last = radius == widest
        done = open_ if last else open_.join(covered, "q", "left_semi")
        best.append(seen.join(done, "q", "left_semi"))
        kth = seen.groupBy("q").agg(F.when(F.sum("n") >= k, F.max("d")).otherwise(bits).cast("int").alias("most"))
        open_ = written(open_.select("q").join(covered, "q", "left_anti").join(kth, "q", "left").select("q", F.coalesce("most", F.lit(bits)).alias("most")), "open")
        if last or not open_.limit(1).count():
            break
    found = best[0]
    for b in best[1:]:
        found = found.union(b)
    rows = found.join(table, "code").select("q", "d", F.explode("ids").alias("id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k)
    lists = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "d"))).alias("near"))
    asking = queries.select("query_id", F.col("code").alias("q"))  # columns of queries may have any other names
    out = asking.join(lists, "q").select("query_id", F.inline("near"))
    return out.select("query_id", "rank", "id", F.col("d").alias("distance"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = table.select(F.col("vec_id").alias("id"), code(F.col("embedding"), width(table)).alias("code"))
    codes = written(codes, "signs")
    queries = codes.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return top_k(codes, queries).select("query_id", F.col("id").alias("vec_id"), "rank", "distance")


_CODE = "list_reduce([CASE WHEN coalesce(embedding[i], 0) > 0 THEN (1::UBIGINT << (i - 1)) ELSE 0::UBIGINT END FOR i IN range(1, 65)], lambda a, b: a | b)"
SQL = f"""
WITH c AS (SELECT vec_id, {_CODE} AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q, c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, vec_id, rank, distance FROM r WHERE rank <= 10"""
