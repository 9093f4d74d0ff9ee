"""Columns that are named as an operator's own, and ids that don't tell rows apart."""

import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import mixing, near_copies, simhash

TAKEN = ("__hash", "__id", "__tie", "__hash_", "key", "component", "fp", "tie", "node")


@pytest.mark.parametrize("operator", [near_copies, simhash])
def test_representatives_keep_columns(spark, operator):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(reversed(words))), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(77) for c in TAKEN})
    out = operator.representatives(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert {r.doc_id for r in found} == {1, 3, None} and all(r[c] == 77 for r in found for c in TAKEN)


def test_rows_without_ids_are_spread_over_shards(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in mixing._numbered(docs, mixing.SEED).groupBy("__shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 6_000
