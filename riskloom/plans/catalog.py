"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads the driver's tables (through the derived views of
``riskloom.sources.fixtures``) and runs over whole tables.  Output columns
are aliased to the same names as the DuckDB statements in
``riskloom.plans.oracle``; doubles are rounded to 6 digits on both sides so
summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans import commerce as C
from riskloom.sources import fixtures as X

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def r6(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column to 6 digits (oracle hashing convention).

    Columns in ``exact`` are left as they are: both engines compute them
    bit-identically, and rounding a value that sits on a half-way point
    differs between the engines' ``round`` implementations.
    """
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" and c not in exact
                       else F.col(c) for c, t in df.dtypes])


FAST_COLUMNS = 20   # up to here the generated method has fewer than the 8,000 bytes that HotSpot still compiles


def _round6(c: str) -> Column:
    """``round(c, 6)`` to the same bits, mostly without a decimal per value.

    With k the integer next to y = c * 1e6, the division k / 1e6 is the double
    next to that decimal.  The margin left to the half-way point (1e-3 and
    1e-13 of y) is far above the error of y, so ``round`` finds the same k;
    closer calls, large values, NaN, infinity and NULL are left to ``round``.
    """
    y = F.coalesce(F.col(c), F.lit(float("nan"))) * F.lit(1e6)
    k = F.rint(y)
    clear = F.abs(y - k) < F.lit(0.499) - F.abs(y) * F.lit(1e-13)
    # adding 0.0 makes -0.0 positive, as a decimal does
    return F.when(clear, k / F.lit(1e6) + F.lit(0.0)).otherwise(F.round(F.col(c), 6)).alias(c)


def r6_scan(df: DataFrame) -> DataFrame:
    """:func:`r6` for a table as it is read from files: the same doubles, but
    seldom a decimal per value.

    Not for a projection on top of others, and not for wide tables: one
    generated method holds it all and, once too long to be compiled, is slower
    than plain ``round``.
    """
    if len(df.columns) > FAST_COLUMNS:
        return r6(df)
    return df.select(*[_round6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------ shared views --

def commerce_geo(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with ip_as_int and ip_country (the as-of join)."""
    return C.with_country(X.commerce_txn(spark, d), X.ip_ranges(spark, d))
