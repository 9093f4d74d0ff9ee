"""Places of rows in a global order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.llm.common import written

_PART = 33  # monotonically_increasing_id keeps the partition above these bits and the row's place in it below


def ranked(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with __rank (long, from 0) of each row in its group by ``order``, and __size, the group's rows.

    Rows are range-partitioned by group and order, so a group of any size lies over many tasks; sorted parts are written,
    a row for each part and group counts what came before, and the rows join it. ``order`` should tell all rows apart:
    rows that it doesn't lie in one part. Null groups are a group; they and null keys come where ``order`` says."""
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("__part", F.shiftright("__at", _PART))
    parts = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__size": F.sum("__n").over(whole)})
    parts = parts.select("__part", "__first", "__before", "__size", *(F.col(g).alias(f"__of_{g}") for g in group))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    found = rows.join(parts.withColumnRenamed("__part", "__to"), (F.col("__part") == F.col("__to")) & same)
    return found.select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("__rank"), "__size")
