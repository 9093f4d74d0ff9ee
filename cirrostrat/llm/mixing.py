"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Words are counted per (source, shard); a shard is a hash range of about ``SHARD_DOCS`` documents of one source, by id and
   text, so a hot source is many shards, whatever its ids, and a small one is one.
2. Targets share all words by weight (1, 2, 3 repeating over the sources in code point order, null last) and stop at
   ``MAX_REPEATS`` times a source's size; the excess is reshared by weight.
3. Blocks of ``block`` words go by highest quotients votes/(2a+1) to sources, from each source to groups of up to
   ``GROUP_SHARDS`` of its shards, and from each group to its shards. A step's task has one source's groups, or one
   group's shards.
4. In a shard the documents lie one after another in seeded order; whole passes first, then the rest of the quota as
   a run of blocks from a seeded block on, going round. A document is taken as far as the run covers it.

The driver holds one row per source; shards stay in tables, and their quotas are broadcast only up to ``MOST_BROADCAST``
rows. Defined cases: null or empty texts have size 0 and are never taken; null ids and repeated rows are rows of their own
(rows equal in id and text may swap results); an empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.llm.common import WORD, written

MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
SHARD_DOCS = 5_000
GROUP_SHARDS = 1_000
MOST_BROADCAST = 100_000
SEED = 9


def targets(sizes: np.ndarray, weights: np.ndarray, max_repeats: float = MAX_REPEATS) -> np.ndarray:
    """Share sum(sizes) by weight, no share above max_repeats * size, the excess reshared until none is above."""
    out, free, rest = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), float(sizes.sum())
    while free.any() and rest > 0:
        share = rest * weights / weights[free].sum()
        over = free & (share > max_repeats * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = max_repeats * sizes[over]
        rest -= float(out[over].sum())
        free &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes/(2a+1), at most ``most`` each; ties go to the earlier party.

    The divisor is found by bisection, then the last few seats one by one, so the cost doesn't grow with the seats.
    """
    votes, most = np.asarray(votes, dtype=float), np.where(np.asarray(votes) > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)  # noqa: E731  quotients of 2d and more
    low, high = votes[votes > 0].min() / (2.0 * most.max() + 2), 2 * votes.max() + 1
    for _ in range(200):
        mid = (low * high) ** 0.5
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while out.sum() < seats:
        quotient = np.where(out < most, votes / (2.0 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
    return out


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, broadcast where its checked number of rows allows it."""
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """Every row as __doc with __no (its source's place in code point order, null last), __size, __shard and an order."""
    spark = docs.sparkSession
    counts = docs.groupBy("source").count().collect()
    counts.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sources = spark.createDataFrame([(r[0], n, max(1, -(-r[1] // SHARD_DOCS))) for n, r in enumerate(counts)], "__source string, __no int, __shards int")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col("source").alias("__own"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("__place"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("__turn"),
        F.xxhash64(text).alias("__tie"),
    )
    joined = rows.join(_small(sources, len(counts)), F.col("__own").eqNullSafe(F.col("__source")))
    return joined.withColumn("__shard", F.pmod("__place", "__shards").cast("int")).drop("__own", "__source", "__place", "__shards")


def source_quotas(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> list[tuple]:
    """(__no, source_size, target, blocks, block) of each source, from ``totals`` (__no, __shard, n)."""
    sizes = {r[0]: r[1] for r in totals.groupBy("__no").agg(F.sum("n")).collect()}
    numbers, z = sorted(sizes), np.array([sizes[n] for n in sorted(sizes)], dtype=np.int64)
    if not len(z):
        return []
    aims = targets(z, np.array([weights[n % len(weights)] for n in numbers], dtype=float), max_repeats)
    block = int(min(1024, max(1, (z[z > 0].min() if (z > 0).any() else 1) // 8192)))
    blocks = sainte_lague(aims, round(float(aims.sum()) / block), -(-max_repeats * z // block))
    return [(n, int(s), float(t), int(b), block) for n, s, t, b in zip(numbers, z, aims, blocks, strict=True)]


def _apportioned(table: DataFrame, keys: tuple[str, ...], given: str, column: str, max_repeats: int) -> DataFrame:
    """``table`` with ``column``: the ``given`` blocks of each group of ``keys`` shared among its rows by their sizes n."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        z, block = t.column("n").to_numpy(), t.column("block")[0].as_py()
        return t.append_column(column, pa.array(sainte_lague(z.astype(float), t.column(given)[0].as_py(), -(-max_repeats * z // block)), pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.groupBy(*keys).applyInArrow(run, f"{kinds}, {column} long")


def quotas(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Each shard's source_size, target, size, whole passes, and the start and length of the run after them, from
    ``totals`` (__no, __shard, n)."""
    spark = totals.sparkSession
    own = source_quotas(totals, weights, max_repeats)
    sources = spark.createDataFrame(own, "__no int, __source_size long, __target double, blocks long, block long")
    grouped = totals.withColumn("group", F.expr(f"__shard div {GROUP_SHARDS}").cast("int"))
    groups = grouped.groupBy("__no", F.col("group").alias("part")).agg(F.sum("n").alias("n")).join(_small(sources, len(own)), "__no")
    groups = _apportioned(groups, ("__no",), "blocks", "of_group", max_repeats).select("__no", F.col("part").alias("group"), "__source_size", "__target", "block", "of_group")
    shards = grouped.select("__no", "group", F.col("__shard").alias("part"), "n").join(groups, ["__no", "group"])
    shards = _apportioned(shards, ("__no", "group"), "of_group", "seats", max_repeats)
    words, n = F.least(F.col("seats") * F.col("block"), F.col("n") * max_repeats), F.greatest(F.col("n"), F.lit(1))
    turn = F.pmod(F.xxhash64(F.lit(seed), "__no", "part"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("block"))))
    return shards.select(
        F.col("__no").alias("__src"), F.col("part").alias("__sh"), "__source_size", "__target", F.col("n").alias("__z"),
        F.floor(words / n).cast("long").alias("__passes"), F.least(turn * F.col("block"), F.col("n")).cast("long").alias("__o"), (words % n).cast("long").alias("__rest"),
    )


def _mixed(docs: DataFrame, weights: tuple[float, ...], max_repeats: int, seed: int, keep: tuple[str, ...] | None) -> DataFrame:
    """Every row as __doc (its ``keep`` columns) with __size, __source_size, __target, __taken and __from."""
    marked = _numbered(docs, seed)
    if keep is not None:
        marked = written(marked.withColumn("__doc", F.struct(*[F.col("__doc").getField(c).alias(c) for c in keep])), "mix")
    totals = written(marked.groupBy("__no", "__shard").agg(F.sum("__size").alias("n")), "totals")
    plan = written(quotas(totals, weights, max_repeats, seed), "quotas")
    order = Window.partitionBy("__no", "__shard").orderBy("__turn", F.col("__size"), "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("__c", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    joined = placed.join(_small(plan, plan.count()), (F.col("__no") == F.col("__src")) & (F.col("__shard") == F.col("__sh")))
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("__c") + F.col("__size"), b) - F.greatest(F.col("__c"), a))
    first, second = overlap(F.col("__o"), F.least(F.col("__o") + F.col("__rest"), F.col("__z"))), overlap(F.lit(0), F.col("__o") + F.col("__rest") - F.col("__z"))
    start = F.when(first > 0, F.greatest(F.lit(0), F.col("__o") - F.col("__c"))).otherwise(F.lit(0)).cast("long")
    return joined.select("__doc", "__size", "__source_size", "__target", (F.col("__passes") * F.col("__size") + first + second).alias("__taken"), start.alias("__from"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with __size, __source_size, __target, __taken and __from: the words taken of
    each document are its whole text floor(taken / size) times and then the words from ``__from`` on, going round. A name
    that ``docs`` has already gets further underscores.

    ``keep`` names the columns to carry (all by default)."""
    out = _mixed(docs, weights, max_repeats, seed, keep)
    kept = list(keep or docs.columns)

    def free(name: str) -> str:
        while name.lower() in {c.lower() for c in kept}:
            name += "_"
        return name

    return out.select(*[F.col("__doc").getField(c).alias(c) for c in kept], *[F.col(c).alias(free(c)) for c in ("__size", "__source_size", "__target", "__taken", "__from")])


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each whole pass and one for a partial run's words (joined by one space)."""
    text = F.col("__doc").getField("text")
    copies = F.when(F.col("__size") > 0, F.expr("__taken div __size")).otherwise(F.lit(0))
    rest = F.col("__taken") - copies * F.col("__size")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    run = F.array_join(F.concat(F.slice(words, (F.col("__from") + 1).cast("int"), rest.cast("int")), F.slice(words, F.lit(1), F.greatest(F.lit(0), F.col("__from") + rest - F.col("__size")).cast("int"))), " ")
    texts = F.concat(F.array_repeat(text, copies.cast("int")), F.when(rest > 0, F.array(run)).otherwise(F.array().cast("array<string>")))
    out = _mixed(docs, WEIGHTS, MAX_REPEATS, SEED, None).withColumn("__text", F.explode(texts))
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs, keep=("doc_id", "source"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))
