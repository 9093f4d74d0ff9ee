"""Runs and running values of a key's whole history, without one task for all of it.

The history is cut into slices of its order. Windows run within slices; what one slice hands to the next is a row per
slice, over which a second window runs, and rows get it back by a join on the keys they are already shuffled by. So a
key that holds a third of all rows is spread over as many tasks as it has slices. Rows without key or order are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers of a slice: as many rows at most, where the order numbers a key's rows.
SLICE = 1_000_000
#: A slice in time: ten minutes in nanoseconds.
SLICE_NS = 600_000_000_000


def sliced(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("__slice", F.expr(f"`{order}` div {size}"))


def runs(rows: DataFrame, key: str, order: str, value: str, starts: Callable[[Column, Column], Column], initial: Column | None = None, size: int = SLICE) -> DataFrame:
    """``rows`` with the struct __before (v: the value of the row before; null for the first row without ``initial``),
    __start (whether ``starts(value, value before)`` holds), __ordinal (starts so far), __total (starts of the key) and
    the struct __next (v: the value of the row that starts the next run; null in the last run)."""
    own = Window.partitionBy(key, "__slice").orderBy(order)
    back = Window.partitionBy(key, "__slice").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(F.col(value).alias("v"))
    holds = lambda v, before: F.coalesce(before.isNotNull() & starts(v, before["v"]), F.lit(False))
    cut = sliced(rows, order, size).withColumn("__before", F.lag(now).over(own))
    cut = cut.withColumn("__start", holds(F.col(value), F.col("__before")))
    cut = cut.withColumn("__local", F.sum(F.col("__start").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("__next", F.last(F.when(F.col("__start"), now), ignorenulls=True).over(back))

    slices = cut.groupBy(key, "__slice").agg(
        F.count_if("__start").alias("__n"), F.min_by(now, order).alias("__first"), F.max_by(now, order).alias("__last"),
        F.min_by(F.when(F.col("__start"), now), F.when(F.col("__start"), F.col(order))).alias("__opened"),
    )
    line = Window.partitionBy(key).orderBy("__slice")
    ahead = Window.partitionBy(key).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    entry = F.lag("__last").over(line)
    slices = slices.withColumn("__entry", entry if initial is None else F.coalesce(entry, F.struct(initial.alias("v"))))
    slices = slices.withColumn("__enters", holds(F.col("__first.v"), F.col("__entry")))
    every = F.col("__n") + F.col("__enters").cast("long")
    slices = slices.withColumns({
        "__offset": F.sum(every).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"),
        "__total": F.sum(every).over(Window.partitionBy(key)),
        "__later": F.last(F.when(F.col("__enters"), F.col("__first")).otherwise(F.col("__opened")), ignorenulls=True).over(ahead),
    })

    out = cut.join(slices.select(key, "__slice", "__entry", "__enters", "__offset", "__total", "__later"), [key, "__slice"])
    out = out.withColumn("__start", F.col("__start") | (F.col("__before").isNull() & F.col("__enters")))
    out = out.withColumns({"__before": F.coalesce("__before", "__entry"), "__ordinal": F.col("__local") + F.col("__offset"), "__next": F.coalesce("__next", "__later")})
    return out.select(*rows.columns, "__before", "__start", "__ordinal", "__total", "__next")


def latest(rows: DataFrame, key: str, order: tuple[Column | str, ...], at: str, value: str, size: int = SLICE_NS) -> DataFrame:
    """``rows`` with ``value`` filled by the last one of their key that isn't null, in ``order`` (which begins with ``at``)."""
    own = Window.partitionBy(key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = sliced(rows, at, size).withColumn(value, F.last(value, ignorenulls=True).over(own))
    ends = cut.groupBy(key, "__slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before))
    return cut.join(ends, [key, "__slice"]).withColumn(value, F.coalesce(value, "__end")).select(*rows.columns)
