"""Order statistics by digits against sorted lists."""

import math
import random
import re
import struct

from pyspark.sql import functions as F

from cirrostrat.operators import selection

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1.7976931348623157e308, math.inf, -math.inf]


def doubles(rng, n):
    powers = [f(2.0**e) for e in rng.sample(range(-1000, 1000), 60) for f in (lambda x: x, lambda x: math.nextafter(x, 0), lambda x: -math.nextafter(x, math.inf))]
    wild = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(n)]
    return ODD + powers + [v for v in wild if not math.isnan(v)]


def test_bits_have_the_order_of_doubles(spark):
    values = doubles(random.Random(3), 2_000)
    got = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double").select("v", selection.ordered_bits("v").alias("b")).collect()
    known = sorted(((r.v, r.b) for r in got if r.v is not None and not math.isnan(r.v)), key=lambda p: p[0])
    for (v, b), (w, c) in zip(known, known[1:]):
        assert (b < c) == (v < w) and (b == c) == (v == w), (v, w)
    assert [r.b for r in got if r.v is None] == [None]
    assert [r.b for r in got if r.v is not None and math.isnan(r.v)][0] > known[-1][1]


def test_percentiles_are_those_of_sorted_lists(spark):
    rng, rows = random.Random(4), []
    for k in (1, 2, 3, None):
        n = {1: 1, 2: 3_000, 3: 257, None: 40}[k]
        rows += [(k, "a", rng.choice([0.5, -0.5, rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randrange(-200, 200)])) for _ in range(n)]
        rows += [(k, "b", None)]
    df = spark.createDataFrame(rows, "frame_id long, part string, v double")
    got = {(r.frame_id, r.part): tuple(r[2:]) for r in selection.percentiles(df, ("frame_id", "part"), "v").collect()}
    want = {}
    for k in (1, 2, 3, None):
        vs = sorted(v for f, p, v in rows if f == k and p == "a")
        want[k, "a"] = tuple(vs[min(len(vs) * p // 100, len(vs) - 1)] for p in (0, 10, 50, 90, 100))
        want[k, "b"] = (None,) * 5
    assert got == want
    assert {(r.frame_id, r.part): r.median for r in selection.upper_median(df.where("part = 'a'"), ("frame_id", "part"), "v").collect()}[2, "a"] == sorted(v for f, p, v in rows if f == 2 and p == "a")[1_500]


def test_names_types_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 9, 2.0), (1, 8, 2.0)], "name long, n int, __v double")
    assert selection.percentiles(df, ("name",), "n", (0, 50)).collect() == [(1, 7, 8)]
    assert selection.at_ranks(df, ("name",), "__v", {"name_at": "n", "rest": "0"}).collect() == [(1, None, 1.0)]
    far = [2**53 + 1, 2**53, -(2**62) - 1, 2**63 - 1, -(2**63)]
    longs = spark.createDataFrame([(1, v) for v in far], "k long, v long")
    assert [tuple(r)[1:] for r in selection.at_ranks(longs, ("k",), "v", {f"r{i}": str(i) for i in range(5)}).collect()] == [tuple(sorted(far))]
    assert selection.percentiles(df.where("n < 0"), ("name",), "n").count() == 0
    assert selection.percentiles(df.withColumn("n", F.col("n").cast("float")), ("name",), "n", (100,)).schema["max"].dataType.simpleString() == "float"


def test_rows_are_read_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), noted(F.col("id").cast("double")).alias("v"))
    got = {r.k: (r.min, r.p50, r.max) for r in selection.percentiles(df, ("k",), "v").collect()}
    assert got == {0: (0.0, 501.0, 999.0), 1: (1.0, 499.0, 997.0), 2: (2.0, 500.0, 998.0)}
    assert seen.value <= 2_000


def test_the_bits_are_compiled(spark):
    df = spark.range(10).select(selection.ordered_bits(F.col("id").cast("double")).alias("b"))
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8_000, sizes  # the JVM interprets longer methods
