"""Per-key running counts and trailing-window counts, skew-safe.

Two features per key (device, IP):

* ``usage_count`` - 1-based running row number of the key's rows ordered by
  (time, tiebreak).  NULL for a NULL key.
* ``freq_window`` - number of the key's rows with a non-NULL ``count_col`` in
  ``(t - window, t]``; rows sharing the same timestamp are counted only up
  to the current row (the row order of a time-sorted rolling count).

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so
a device holding a third of all rows would become a third of the job in one
task.  Instead the rows are partitioned by ``(key, time bucket)`` with the
bucket as wide as the window:

* the trailing count needs at most the previous bucket, so each row is sent
  once to its own bucket (all columns) and once, as a narrow *halo* row, to
  the next bucket; the RANGE frame then runs inside ``(key, bucket)``;
* the running count is the row number inside ``(key, bucket)`` plus an
  offset: the key's row count in all earlier buckets, from a pre-aggregated
  ``(key, bucket) -> count`` table whose cumulative sum is a window over at
  most (time span / bucket) rows per key.

The windows over ``(key, bucket)`` and ``(key, bucket, time)`` share one
Exchange (hash partitioning on a subset of the clustering keys), and the
offset join reuses that partitioning on the large side.  NULL keys never
enter the windows; they are unioned back with NULL features.

:func:`key_velocity_ranged` removes the remaining limit - a burst of one
key inside one bucket - by range partitioning on the total order (key,
time, id) instead of time buckets; see its docstring.
:func:`key_velocity_auto` (used by the feature build) measures the largest
(key, hour) group first and takes the range plan only when it is needed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = _dt.datetime(1970, 1, 1)
HOUR_US = 3_600_000_000


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 for a TIMESTAMP_NTZ, independent of time zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col)


def key_velocity(df: DataFrame, key: str, ts: str, order_col: str,
                 count_col: str | None = None,
                 usage_out: str | None = "usage_count",
                 freq_out: str | None = None,
                 window_us: int = HOUR_US,
                 bucket_us: int | None = None) -> DataFrame:
    """Append ``usage_out`` and/or ``freq_out`` to ``df`` (see module doc).

    ``count_col`` is the column whose non-NULL values the trailing count
    counts (defaults to ``order_col``).  Rows with a NULL key or NULL time
    get NULL features.
    """
    if usage_out is None and freq_out is None:
        return df
    bucket_us = bucket_us or window_us
    if bucket_us < window_us:
        raise ValueError("bucket must be at least as wide as the window")
    count_col = count_col or order_col
    cols = df.columns
    valid = F.col(key).isNotNull() & F.col(ts).isNotNull()
    keyed = df.where(valid)
    rest = df.where(~valid)

    tus = epoch_micros(ts)
    own = (keyed.withColumn("_tus", tus)
           .withColumn("_b", F.floor(F.col("_tus") / F.lit(bucket_us)).cast("bigint"))
           .withColumn("_own", F.lit(1)))
    parts = own
    if freq_out is not None:
        halo = own.select(key, "_tus", order_col,
                          *([count_col] if count_col not in (key, order_col) else []),
                          (F.col("_b") + 1).alias("_b"), F.lit(0).alias("_own"))
        parts = own.unionByName(halo, allowMissingColumns=True)

    in_bucket = Window.partitionBy(key, "_b")
    out = parts
    if freq_out is not None:
        frame = in_bucket.orderBy("_tus").rangeBetween(-(window_us - 1), 0)
        peers = Window.partitionBy(key, "_b", "_tus")
        peers_upto = peers.orderBy(order_col).rowsBetween(Window.unboundedPreceding,
                                                          Window.currentRow)
        cnt = F.col(count_col)
        out = out.withColumn(
            freq_out,
            (F.count(cnt).over(frame) - F.count(cnt).over(peers)
             + F.count(cnt).over(peers_upto)).cast("bigint"))
    if usage_out is not None:
        running = in_bucket.orderBy("_tus", order_col).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_local", F.sum("_own").over(running))
    out = out.where(F.col("_own") == 1)

    if usage_out is not None:
        per_bucket = own.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
        by_key = Window.partitionBy(key).orderBy("_b").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        offsets = per_bucket.select(key, "_b", (F.sum("_n").over(by_key) - F.col("_n")).alias("_off"))
        out = out.join(offsets, [key, "_b"], "inner")
        out = out.withColumn(usage_out, (F.col("_local") + F.col("_off")).cast("bigint"))

    new_cols = [c for c in (usage_out, freq_out) if c is not None]
    out = out.select(*cols, *new_cols)
    rest = rest.select(*cols, *[F.lit(None).cast("bigint").alias(c) for c in new_cols])
    return out.unionByName(rest)


def key_velocity_ranged(df: DataFrame, key: str, ts: str, order_col: str,
                        count_col: str | None = None,
                        usage_out: str | None = "usage_count",
                        freq_out: str | None = None,
                        window_us: int = HOUR_US,
                        partitions: int | None = None) -> DataFrame:
    """Same result as :func:`key_velocity`, robust to any burst.

    ``order_col`` must be unique.  Counts are cumulative counts in the total
    order (key, time, order): the running count is C(row) and the trailing
    count is C(row) - C(t - window), where the second term comes from a
    *probe* row placed at (key, t - window) after all rows of that instant.
    Rows and probes are range-partitioned on the total order (the sampled
    range bounds split a hot key, even a hot instant, over many partitions),
    cumulative sums run in windows over (range partition, key) - each at
    most one partition's rows - and per-(partition, key) offsets come from
    a small aggregate.  Probe results rejoin their rows on ``order_col``.
    """
    if usage_out is None and freq_out is None:
        return df
    count_col = count_col or order_col
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    valid = F.col(key).isNotNull() & F.col(ts).isNotNull()
    keyed, rest = df.where(valid), df.where(~valid)
    base = keyed.select(F.col(key).alias("_k"), epoch_micros(ts).alias("_t"),
                        F.col(order_col).alias("_o"), F.col(count_col).isNotNull().cast("long").alias("_c"))
    rows = base.select("_k", "_t", F.lit(0).alias("_p"), "_o", F.lit(1).cast("long").alias("_w"), "_c")
    u = rows
    if freq_out is not None:
        probes = base.select("_k", (F.col("_t") - F.lit(window_us)).alias("_t"), F.lit(1).alias("_p"),
                             "_o", F.lit(0).cast("long").alias("_w"), F.lit(0).cast("long").alias("_c"))
        u = rows.unionByName(probes)
    ranged = u.repartitionByRange(parts, "_k", "_t", "_p", "_o").withColumn(
        "_pid", F.spark_partition_id())
    run = Window.partitionBy("_pid", "_k").orderBy("_t", "_p", "_o").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("_pid", "_k", "_p", "_o", F.sum("_w").over(run).alias("_lw"),
                          F.sum("_c").over(run).alias("_lc"), "_w", "_c")
    # three branches read the partition ids: materialise once (reliable
    # checkpoint in the shared folder) so all see one range partitioning and
    # the range exchange runs a single time
    from riskloom.session import cut_lineage
    local = cut_lineage(local)
    tot = local.groupBy("_pid", "_k").agg(F.sum("_w").alias("_tw"), F.sum("_c").alias("_tc"))
    earlier = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", "_k", F.coalesce(F.sum("_tw").over(earlier), F.lit(0)).alias("_ow"),
                     F.coalesce(F.sum("_tc").over(earlier), F.lit(0)).alias("_oc"))
    full = local.join(off, ["_pid", "_k"]).select(
        "_p", "_o", (F.col("_lw") + F.col("_ow")).alias("_W"), (F.col("_lc") + F.col("_oc")).alias("_C"))
    res = full.where(F.col("_p") == 0).select("_o", "_W", "_C")
    new_cols = []
    if usage_out is not None:
        new_cols.append(F.col("_W").cast("bigint").alias(usage_out))
    if freq_out is not None:
        pr = full.where(F.col("_p") == 1).select("_o", F.col("_C").alias("_Cp"))
        res = res.join(pr, "_o")
        new_cols.append((F.col("_C") - F.col("_Cp")).cast("bigint").alias(freq_out))
    res = res.select(F.col("_o"), *new_cols)
    names = [c for c in (usage_out, freq_out) if c]
    out = keyed.join(res, keyed[order_col] == res["_o"]).select(*[keyed[c] for c in cols],
                                                                  *[res[n] for n in names])
    rest = rest.select(*cols, *[F.lit(None).cast("bigint").alias(c) for c in names])
    return out.unionByName(rest)


# A (key, hour) window partition up to this many rows is one task's work;
# above it the range-partitioned plan is used.
MAX_GROUP_ROWS = 2_000_000


def largest_groups(df: DataFrame, keys: list[str], ts: str, bucket_us: int = HOUR_US) -> dict:
    """Largest (key, time bucket) row count per key column, one job for all keys
    (partial aggregates; one row reaches the driver)."""
    b = F.floor(epoch_micros(ts) / F.lit(bucket_us)).cast("bigint")
    out = None
    for k in keys:
        g = (df.where(F.col(k).isNotNull() & F.col(ts).isNotNull())
             .groupBy(F.col(k).cast("string").alias("_k"), b.alias("_b")).count()
             .agg(F.max("count").alias("m")).select(F.lit(k).alias("key"), "m"))
        out = g if out is None else out.unionByName(g)
    got = {r["key"]: int(r["m"] or 0) for r in out.collect()}  # one row per key column
    return {k: got.get(k, 0) for k in keys}


def key_velocity_auto(df: DataFrame, key: str, ts: str, order_col: str,
                      max_group_rows: int = MAX_GROUP_ROWS, largest: int | None = None,
                      **kw) -> DataFrame:
    """Bucketed windows while the largest (key, hour) group fits a task,
    the range-partitioned plan when a burst exceeds it."""
    if largest is None:
        largest = largest_groups(df, [key], ts)[key]
    fn = key_velocity if largest <= max_group_rows else key_velocity_ranged
    return fn(df, key, ts, order_col, **kw)


def usage_count(df: DataFrame, key: str, ts: str, order_col: str,
                out: str = "usage_count", method: str = "auto") -> DataFrame:
    fn = {"ranged": key_velocity_ranged, "buckets": key_velocity, "auto": key_velocity_auto}[method]
    return fn(df, key, ts, order_col, usage_out=out, freq_out=None)


def trailing_count(df: DataFrame, key: str, ts: str, order_col: str, count_col: str,
                   out: str = "freq_1h", window_us: int = HOUR_US, method: str = "auto") -> DataFrame:
    fn = {"ranged": key_velocity_ranged, "buckets": key_velocity, "auto": key_velocity_auto}[method]
    return fn(df, key, ts, order_col, count_col=count_col, usage_out=None,
              freq_out=out, window_us=window_us)
