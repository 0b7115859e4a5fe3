"""Rounding of results: the quick form gives the doubles of the plain one."""

import math
import random
import re
import struct

from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom.plans.catalog import FAST_COLUMNS, r6, r6_scan


def _bits(rows):
    return [tuple("nan" if v is not None and math.isnan(v) else v and struct.pack(">d", v) or str(v) for v in r) for r in rows]


def _values():
    """Doubles on, next to and far from half a millionth; signs, zeros, sizes."""
    rnd = random.Random(21)
    out = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -1e-9, 5e-7, 4.9e-7, 5.1e-7, 0.1234565, 1.0000005,
           2.5e-6, 1.7976931348623157e308, 1e300, 9007199254740993.0, 4503599627.3704955, 2.0 ** 52 / 1e6, 1e15 + 0.5]
    for size in (1e-7, 1e-3, 1.0, 30.0, 1e3, 1e5, 4.9e6, 5.1e6, 1e9, 1e10, 1e12):
        for _ in range(300):
            x = rnd.uniform(-size, size)
            half = (math.floor(x * 1e6) + 0.5) / 1e6
            out += [x, round(x, 6), half, math.nextafter(half, math.inf), math.nextafter(half, -math.inf)]
    return out


def test_quick_rounding_is_bit_for_bit_the_plain_one(spark):
    df = spark.createDataFrame([(v, v) for v in _values()], "a double, b double").coalesce(1)
    want = _bits(df.select(F.round("a", 6), F.round("b", 6)).collect())
    assert _bits(r6_scan(df).collect()) == want
    assert _bits(r6(df).collect()) == want


def test_quick_rounding_leaves_other_columns_and_their_order(spark):
    df = spark.createDataFrame([(1, 0.12345678, "x", 2.0)], "i int, d double, s string, e double")
    out = r6_scan(df)
    assert out.dtypes == df.dtypes
    assert [tuple(r) for r in out.collect()] == [(1, 0.123457, "x", 2.0)]


def test_generated_code_of_wide_tables_is_still_compiled(spark, tmp_path):
    """HotSpot interprets methods of more than 8,000 bytes."""
    for n in (FAST_COLUMNS, 2 * FAST_COLUMNS):
        path = str(tmp_path / f"t{n}")
        spark.range(10).select(*[(F.col("id") / 7).alias(f"c{i}") for i in range(n)]).write.parquet(path)
        out = r6_scan(spark.read.parquet(path))
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(out._jdf.queryExecution().executedPlan())
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000, (n, sizes)


def test_scans_of_written_tables_do_not_make_a_decimal_of_every_double(spark):
    for name in ("scan_processed", "sink_processed", "scan_card", "scan_commerce", "sink_scores"):
        df = E.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all(f"ELSE round({c}#" in plan for c, t in df.dtypes if t == "double"), name
