"""Document fingerprints by threshold-scaled sketches of word shingles, in DataFrame functions throughout.

A sketch keeps every shingle hash below a fixed fraction of all hashes (one in ``SCALE``), so it grows with the text and
two sketches are comparable whatever the sizes of their documents: the share of one sketch's hashes that the other has
estimates how much of the one text is contained in the other. Sketches merge: that of several texts' shingles together is
the union of theirs. A text whose hashes all lie above the threshold keeps its lowest one instead, which merging drops as
soon as another text brings one below; so short texts that differ don't share a fingerprint.

A shingle is ``WORDS`` consecutive words (runs of anything but ASCII white space, unchanged); a shorter text is one
shingle, a text without words has none and an empty fingerprint. Hashes are Spark's xxhash64 over a shingle's words, less
its lowest bit; a fingerprint is the sketch's hashes in ascending order, 16 hex digits each.

The query also edits every text: its last third gives way to the beginning of the next document's. Documents are put in
order by ids alone; texts are shuffled once, by a digest of id and text, and the piece that a neighbour needs goes to it.

Defined cases: a null text is empty; null ids come last in descending order; rows that repeat an id are documents of their
own, ordered by a digest of id and text, and rows equal in both follow one another; one document alone is its own next one;
two empty fingerprints are alike (1), an empty one is like no other (0); a very long text is an array of its words in one
task; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import written
from cirrostrat.llm.ranks import ranked

WORDS = 5
SCALE = 8
_SPACE = r"[\x20\x09-\x0D]+"
_LONGS = "array<bigint>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lowest(hashes: Column, scale: int) -> Column:
    """Of hashes: those below the threshold, or the lowest one if there are none; ascending, each once."""
    below = lambda h: h < (1 << 63) // scale
    none = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast(_LONGS))
    return _let(F.filter(hashes, below), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(none))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sketch of a text: array of hashes of 63 bits."""
    hashed = lambda ws, i: F.call_function("shiftrightunsigned", F.xxhash64(F.slice(ws, i, words)), F.lit(1))
    shingles = lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - words + 1, F.lit(1))), lambda i: hashed(ws, i))).otherwise(F.array().cast(_LONGS))
    return _let(_let(F.array_remove(F.split(text, _SPACE), ""), shingles), lambda hashes: _lowest(hashes, scale))


def fingerprint(kept: Column) -> Column:
    """A sketch as text."""
    return F.lower(F.array_join(F.transform(kept, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def hashes(fingerprint: Column) -> Column:
    """The sketch that a fingerprint holds."""
    return F.transform(F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{16}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def containment(a: Column, b: Column) -> Column:
    """Share of sketch ``a`` that ``b`` has: how much of a's text is contained in b's."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches."""
    return F.when((F.size(a) > 0) | (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(1.0))


def merged(sketches: DataFrame, group: list[str], kept: str = "sketch", scale: int = SCALE) -> DataFrame:
    """One sketch per group, as of all its texts' shingles together. Hashes are told apart by an aggregation of their own
    first, so a group's copies don't meet in one task."""
    each = sketches.select(*group, F.explode(kept).alias("__h")).distinct()
    found = each.groupBy(*group).agg(F.sort_array(F.collect_list("__h")).alias("__all"))
    return found.select(*group, _lowest(F.col("__all"), scale).alias(kept))


def _third(n: Column) -> Column:
    return F.floor(n / 3).cast("int")


def edited(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its edited text and three sketches: doc_id, n_chars, edited, sketch,
    edited_sketch, next_sketch."""
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256))
    docs = docs.select("doc_id", key.alias("key"), text.alias("text"))
    # The order, from ids and lengths alone: place of each document, how many rows it has, what the one before it needs.
    ids = written(docs.groupBy("key", "doc_id", F.char_length("text").alias("n")).count(), "ids")
    placed = written(ranked(ids, [], [F.col("doc_id").desc_nulls_last(), F.col("key")]), "order")
    needs = placed.select(F.col("key").alias("to"), _third(F.col("n")).alias("need"), ((F.col("__rank") + 1) % F.col("__size")).alias("__rank"))
    needs = written(placed.select("key", "__rank").join(needs, "__rank").drop("__rank"), "needs")
    # The texts, one of each digest; both readers below take them from this shuffle.
    texts = docs.select("key", "text", sketch(F.col("text"), words, scale).alias("sketch")).groupBy("key").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"))
    pieces = texts.join(needs, "key").select(F.col("to").alias("key"), F.expr("left(text, need)").alias("piece"), F.col("sketch").alias("next_sketch"))
    # Of rows equal in id and text each but the last is followed by its own copy.
    rows = placed.select("key", "doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"), "count")
    rows = rows.select("key", "doc_id", F.col("n").cast("long").alias("n_chars"), (F.col("copy") < F.col("count")).alias("again"))
    found = texts.join(rows, "key").join(pieces, "key")
    third = _third(F.col("n_chars"))
    kept = F.call_function("left", F.col("text"), F.col("n_chars").cast("int") - third)
    piece = F.when(F.col("again"), F.call_function("left", F.col("text"), third)).otherwise(F.col("piece"))
    found = found.select("doc_id", "n_chars", F.concat(kept, piece).alias("edited"), "sketch", F.when(F.col("again"), F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"))
    return found.withColumn("edited_sketch", sketch(F.col("edited"), words, scale))


def op12_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, and the share of a text's sketch that the other has."""
    found = edited(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
