"""Backward as-of join of a point (IP) onto a table of [lower, upper] ranges.

Semantics: each row takes the range with the greatest ``lower <= ip``
(duplicated lowers: the last one in (lower, upper, payload) order), and keeps
that range's payload only if ``ip <= upper``; rows without a match keep
NULL.  Row count of the left side is preserved.

Spark has no as-of operator and a bare ``between`` predicate plans as a
nested-loop join.  The plan here is:

1. **Disjoint ranges.**  The nearest-lower rule makes every range effective
   only on ``[lower, min(upper, next_lower - 1)]``.  ``next_lower`` needs an
   ordered pass over the ranges; it is computed in two levels so that no
   single task sees the whole range table: ``lead`` inside coarse buckets of
   ``lower``, and for the last range of a bucket the first ``lower`` of the
   next non-empty bucket (a ``lead`` over <= 2**16 bucket rows).
2. **Bucketed equi-join.**  Disjoint ranges are exploded over fine buckets
   ``value >> k``; with ``k`` chosen from the span/count statistics the
   exploded table is at most ``n_ranges + span >> k`` rows (about 2x the
   ranges).  The points are joined on ``bucket`` (equi key) plus the
   ``between`` residual, which is exact because the ranges are disjoint.
3. **Physical choice.**  The exploded table is broadcast only when its
   proven row bound is under ``broadcast_rows``; otherwise both sides are
   hash-partitioned on the bucket and AQE's skew-join splits a hot bucket
   on the (large) point side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, drop_scratch

DEFAULT_BROADCAST_ROWS = 2_000_000
_COARSE_BUCKETS_LOG2 = 16


@dataclass(frozen=True)
class RangeStats:
    n: int
    lo: int
    hi: int

    @property
    def span(self) -> int:
        return max(self.hi - self.lo, 0) + 1


def range_stats(ranges: DataFrame, lower: str, upper: str) -> RangeStats:
    """One aggregate row (count, min lower, max upper): a bounded driver fetch."""
    row = ranges.agg(F.count(F.lit(1)).alias("n"), F.min(lower).alias("lo"),
                     F.max(upper).alias("hi")).first()
    n = int(row["n"] or 0)
    lo = int(row["lo"]) if row["lo"] is not None else 0
    hi = int(row["hi"]) if row["hi"] is not None else 0
    return RangeStats(n, lo, hi)


def _shift_for(span: int, target_buckets: int) -> int:
    if span <= 1 or target_buckets <= 0:
        return 0
    return max(0, math.ceil(math.log2(span / max(target_buckets, 1))))


def disjoint_ranges(ranges: DataFrame, lower: str, upper: str, payload: list[str],
                    stats: RangeStats | None = None) -> DataFrame:
    """Ranges rewritten to ``[lo, hi]`` intervals under the nearest-lower rule.

    Output columns: ``lo, hi`` (bigint) + payload.  Empty intervals (shadowed
    duplicates, inverted ranges, NULL bounds) are removed.
    """
    stats = stats or range_stats(ranges, lower, upper)
    coarse_shift = _shift_for(stats.span, 2 ** _COARSE_BUCKETS_LOG2)
    r = ranges.select(F.col(lower).cast("bigint").alias("lo"),
                      F.col(upper).cast("bigint").alias("up"), *payload)
    r = r.where(F.col("lo").isNotNull() & F.col("up").isNotNull())
    # offset by the minimum so the coarse bucket id is non-negative and bounded
    r = r.withColumn("cb", F.shiftright(F.col("lo") - F.lit(stats.lo), coarse_shift))
    order = [F.col("lo"), F.col("up")] + [F.col(p) for p in payload]
    in_bucket = Window.partitionBy("cb").orderBy(*order)
    r = r.withColumn("next_in_bucket", F.lead("lo").over(in_bucket))
    # first lower of the next non-empty coarse bucket: <= 2**16 rows in total
    firsts = r.groupBy("cb").agg(F.min("lo").alias("first_lo"))
    firsts = firsts.select("cb", F.lead("first_lo").over(Window.orderBy("cb")).alias("next_bucket_lo"))
    r = r.join(F.broadcast(firsts), "cb", "left")
    nxt = F.coalesce(F.col("next_in_bucket"), F.col("next_bucket_lo"))
    hi = F.when(nxt.isNull(), F.col("up")).otherwise(F.least(F.col("up"), nxt - 1))
    return (r.select("lo", hi.alias("hi"), *payload)
            .where(F.col("lo") <= F.col("hi")))


def asof_range_join(points: DataFrame, point_col: str, ranges: DataFrame,
                    lower: str, upper: str, payload: list[str],
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Left as-of join of ``points[point_col]`` (bigint) onto the ranges.

    Returns ``points`` with the payload columns appended (NULL on no match).
    """
    stats = range_stats(ranges, lower, upper)
    dis = disjoint_ranges(ranges, lower, upper, payload, stats)
    shift = _shift_for(stats.span, max(stats.n, 1))
    bucket_bound = (stats.span >> shift) + 1
    exploded_bound = stats.n + bucket_bound
    ex = dis.select(
        F.explode(F.sequence(F.shiftright(F.col("lo"), shift),
                             F.shiftright(F.col("hi"), shift))).alias("_bkt"),
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *payload)
    if exploded_bound <= broadcast_rows:
        ex = F.broadcast(ex)
    p = points.withColumn("_bkt", F.shiftright(F.col(point_col), shift))
    cond = ((p["_bkt"] == ex["_bkt"]) & (p[point_col] >= ex["_lo"])
            & (p[point_col] <= ex["_hi"]))
    out = p.join(ex, cond, "left")
    return out.select(*[p[c] for c in points.columns], *[ex[c] for c in payload])


class RangeIndex:
    """The exploded, disjoint range table built once and reused for many
    point batches (micro-batches of a stream, repeated scoring runs)."""

    def __init__(self, ranges: DataFrame, lower: str, upper: str, payload: list[str],
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
        self.payload = list(payload)
        self.stats = range_stats(ranges, lower, upper)
        self.shift = _shift_for(self.stats.span, max(self.stats.n, 1))
        bound = self.stats.n + (self.stats.span >> self.shift) + 1
        dis = disjoint_ranges(ranges, lower, upper, payload, self.stats)
        self.exploded = cut_lineage(dis.select(
            F.explode(F.sequence(F.shiftright(F.col("lo"), self.shift),
                                 F.shiftright(F.col("hi"), self.shift))).alias("_bkt"),
            F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *payload), "ranges")
        self.broadcast = bound <= broadcast_rows

    def release(self) -> None:
        """Delete the index's table, once no join needs it."""
        drop_scratch(self.exploded)

    def join(self, points: DataFrame, point_col: str) -> DataFrame:
        ex = F.broadcast(self.exploded) if self.broadcast else self.exploded
        p = points.withColumn("_bkt", F.shiftright(F.col(point_col), self.shift))
        cond = ((p["_bkt"] == ex["_bkt"]) & (p[point_col] >= ex["_lo"]) & (p[point_col] <= ex["_hi"]))
        out = p.join(ex, cond, "left")
        return out.select(*[p[c] for c in points.columns], *[ex[c] for c in self.payload])


def broadcast_range_join(points: DataFrame, point_col: str, ranges: DataFrame,
                         lower: str, upper: str, payload: list[str],
                         max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Same result via a broadcast theta join on the disjoint ranges.

    Only valid for small range tables: the row count is checked first and a
    table above ``max_rows`` is refused (use :func:`asof_range_join`).
    """
    stats = range_stats(ranges, lower, upper)
    if stats.n > max_rows:
        raise ValueError(f"range table has {stats.n} rows > {max_rows}; "
                         "use asof_range_join")
    dis = F.broadcast(disjoint_ranges(ranges, lower, upper, payload, stats))
    cond = (points[point_col] >= dis["lo"]) & (points[point_col] <= dis["hi"])
    out = points.join(dis, cond, "left")
    return out.select(*[points[c] for c in points.columns], *[dis[c] for c in payload])
