"""Exact order statistics without a group's sorted values.

A double becomes a 64-bit integer of the same order (integers are one already), and that is narrowed down by three digits. Each digit's
histogram is an aggregation that Spark combines before the shuffle. The rows are read twice: for the first digit's histogram,
and for the values whose first digit holds a rank, which are written with their counts. A group that holds a third of all
rows costs no task more than its histogram, at most 2^22 rows however many values there are.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.tables import written

#: Bits below each digit: the first has sign, exponent and ten bits of the fraction.
SHIFTS = (42, 21, 0)
LOWEST = -1022


def ordered_bits(c: Column | str) -> Column:
    """A long with the order of a double: negative values below zero, both zeros equal, NaN above all; null stays null.

    No part stands in a branch, so that Spark works out each once a row and the code stays short enough to be compiled."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    a = F.abs(v)
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))  # noqa: E731 - exact for whole exponents
    normal = F.greatest(F.lit(2.0**LOWEST), F.least(F.lit(sys.float_info.max), a))
    guess = F.greatest(F.lit(LOWEST), F.least(F.lit(1023), F.floor(F.log2(normal)).cast("int")))
    # the logarithm may be off by one next to a power of two
    exponent = guess - (normal < power(guess)).cast("int") + ((guess < 1023) & (normal / 2 >= power(guess))).cast("int")
    bits = F.shiftleft((exponent + 1023).cast("long"), 52) + ((normal / power(exponent) - 1) * F.lit(2.0**52)).cast("long")
    # what was cut off: values below the lowest normal one, infinity, NaN
    tiny = (F.least(F.lit(2.0**LOWEST), a) / F.lit(2.0**LOWEST) * F.lit(2.0**52)).cast("long") - F.lit(1 << 52)
    beyond = (a == float("inf")).cast("long") + F.isnan(v).cast("long") * 2
    return (bits + tiny + beyond) * F.when(v < 0, -1).otherwise(1)


def _same(left: str, right: str, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in names])


def at_ranks(rows: DataFrame, keys: tuple[str, ...], value: str, ranks: dict[str, str]) -> DataFrame:
    """One row per group of ``keys``: of the sorted non-null ``value``s the one at each rank. ``ranks`` names output columns
    and gives SQL of the rank from 0, in terms of ``n``, the group's number of values.

    Null keys are a group; ties and repeated rows count as often as they occur; a group without values, and a rank outside
    0 to n - 1, give null; an empty table gives no rows. Of zeros with and without a sign either may come out."""
    own = tuple(f"__k{i}" for i in range(len(keys)))
    whole = dict(rows.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    code = F.col(value).cast("long") if whole else ordered_bits(value)
    bits = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).alias("__v"), code.alias("__bits"))
    values = bits.withColumn("__d0", F.shiftright("__bits", SHIFTS[0]))

    counts = values.groupBy(*own, "__d0").agg(F.count("__v").alias("c"))
    group = Window.partitionBy(*own)
    counts = counts.withColumn("n", F.sum("c").over(group)).withColumn("before", F.sum("c").over(group.orderBy("__d0")) - F.col("c"))
    rest = {name: F.expr(f"cast({sql} as long)") - F.col("before") for name, sql in ranks.items()}
    # a row for each group, also for those without values
    here = [F.max(F.when((r >= 0) & (r < F.col("c")), F.struct("__d0", r.alias("rest")))).alias(f"__r{i}") for i, r in enumerate(rest.values())]
    groups = written(counts.groupBy(*own).agg(*here), "groups")
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"__r{i}").alias("at")) for i, name in enumerate(ranks)]))
    wanted = groups.select(*own, each).where("at is not null").select(*own, F.col("at.__d0").alias("__d0"), "name", F.col("at.rest").alias("rest"))

    # the values of the digits that hold a rank, ties together; only these are looked at from here on
    first = (*own, "__d0")
    some = values.alias("v").join(wanted.select(*first).distinct().alias("w"), _same("v", "w", first), "left_semi")
    some = written(some.groupBy(*first, "__bits").agg(F.count("*").alias("c"), F.min("__v").alias("__v")), "values")
    digits = some.select(*first, "c", "__v", *[F.shiftright("__bits", s).alias(f"__d{i}") for i, s in enumerate(SHIFTS) if i])
    for i in range(1, len(SHIFTS)):
        before = own + tuple(f"__d{j}" for j in range(i))
        last = i == len(SHIFTS) - 1
        some = digits.alias("v").join(wanted.select(*before).distinct().alias("w"), _same("v", "w", before), "left_semi")
        found = some.groupBy(*before, f"__d{i}").agg(F.sum("c").alias("c"), F.min("__v").alias("found"))
        line = Window.partitionBy(*before).orderBy(f"__d{i}")
        found = found.withColumn("before", F.sum("c").over(line) - F.col("c"))
        both = found.alias("f").join(wanted.alias("w"), _same("f", "w", before)).where("w.rest >= f.before and w.rest < f.before + f.c")
        kept = both.select(*[f"f.{k}" for k in before], f"f.__d{i}", "w.name", (F.col("w.rest") - F.col("f.before")).alias("rest"), "f.found")
        wanted = kept if last else written(kept.drop("found"), "ranks")
    values = wanted.groupBy(*own).agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ranks])
    out = groups.alias("g").join(values.alias("x"), _same("g", "x", own), "left")
    return out.select(*[F.col(f"g.{o}").alias(k) for o, k in zip(own, keys, strict=True)], *[F.col(f"x.{name}").alias(name) for name in ranks])


def percentiles(rows: DataFrame, keys: tuple[str, ...], value: str, points: tuple[int, ...] = (0, 10, 50, 90, 100)) -> DataFrame:
    """Values at index n * percent div 100 of each group's sorted values (the last one for 100): min, p10, p50, p90, max."""
    return at_ranks(rows, keys, value, {{0: "min", 100: "max"}.get(p, f"p{p}"): f"least(n * {p} div 100, n - 1)" for p in points})


def upper_median(rows: DataFrame, keys: tuple[str, ...], value: str, name: str = "median") -> DataFrame:
    """The value at index n div 2 of each group's sorted values."""
    return at_ranks(rows, keys, value, {name: "n div 2"})
