"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.common import written


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges``; isolated nodes aren't listed.

    A round moves every edge towards smaller neighbours; rounds grow with the logarithm of the longest chain. Each
    round's edges are a table in the shared folder, and only two numbers come to the driver."""
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select("v", "m").where("v <> m").union(lowest.select("u", "m")).toDF("u", "v").distinct()
        now = written(small, "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(found) == before:
            break
        before = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct().toDF("node", "component")).distinct()
