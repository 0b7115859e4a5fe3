"""Grouped and global aggregates (EDA tables, fitted country state).

All group aggregates are plain ``groupBy().agg()`` so Spark does a partial
(map-side) aggregate before the shuffle: a hot key costs one partial row per
input partition, not a hot task.  "Aggregate attached back to rows" is
agg + join (AQE turns the join into a broadcast when the aggregate turns
out small at run time, or splits a hot key on the row side when it does not).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import HIGH_RISK_MIN_COUNT, HIGH_RISK_RATE


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ------------------------------------------------------------ country ------

def country_fraud(df: DataFrame, country: str = "ip_country", label: str = "class") -> DataFrame:
    """Per known country: total_transactions, fraud_count, fraud_rate."""
    return (df.where(F.col(country).isNotNull())
            .groupBy(country)
            .agg(F.count(label).alias("total_transactions"),
                 F.sum(label).cast("bigint").alias("fraud_count"))
            .withColumn("fraud_rate", _dbl("fraud_count") / _dbl("total_transactions")))


def country_stats_fit(df: DataFrame, country: str = "ip_country", label: str = "class") -> DataFrame:
    """Fitted state: per known country count and mean label."""
    return (df.where(F.col(country).isNotNull())
            .groupBy(country)
            .agg(F.count(label).alias("n"), F.avg(_dbl(label)).alias("fraud_rate")))


def high_risk_set(stats: DataFrame, country: str = "ip_country",
                  min_rate: float = HIGH_RISK_RATE,
                  min_count: int | None = HIGH_RISK_MIN_COUNT,
                  rate_col: str = "fraud_rate", count_col: str = "n") -> DataFrame:
    """Countries with rate > min_rate and (if given) count > min_count, both strict."""
    cond = F.col(rate_col) > F.lit(float(min_rate))
    if min_count is not None:
        cond = cond & (F.col(count_col) > F.lit(int(min_count)))
    return stats.where(cond).select(country)


def flag_in_set(df: DataFrame, value_col: str, members: DataFrame, member_col: str,
                out: str) -> DataFrame:
    """``value in learned set`` -> 0/1 via a left join to the (distinct) set.

    The set has one row per distinct fitted value (countries); no broadcast
    hint: AQE broadcasts it at run time when its measured size is small and
    keeps a shuffled join otherwise.  An empty set yields 0 everywhere.
    """
    flag = members.select(F.col(member_col).alias("_m")).distinct().withColumn("_hit", F.lit(1))
    joined = df.join(flag, df[value_col] == flag["_m"], "left")
    return joined.select(*[df[c] for c in df.columns],
                         F.coalesce(F.col("_hit"), F.lit(0)).alias(out))


# ---------------------------------------------------- transform-back -------

def attach_group_aggs(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates attached to every row of the group; NULL key -> NULL.

    agg (partial, skew-proof) + left join on the key; NULL keys do not join.
    """
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[expr.alias(name) for name, expr in aggs.items()])
    return df.join(stats, key, "left").select(*df.columns, *aggs.keys())


def key_frequency(df: DataFrame, key: str, out: str) -> DataFrame:
    return attach_group_aggs(df, key, {out: F.count(F.lit(1))})


def distinct_users(df: DataFrame, key: str, user: str, out: str) -> DataFrame:
    """Distinct non-NULL users per key on each row (window COUNT DISTINCT is not allowed)."""
    return attach_group_aggs(df, key, {out: F.count_distinct(user)})


# ------------------------------------------------------------ summaries ----

def dataset_summary(df: DataFrame, label: str = "class") -> DataFrame:
    n = F.count(F.lit(1))
    fraud = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.agg(
        n.alias("n_rows"),
        fraud.cast("bigint").alias("n_fraud"),
        (F.when(n > 0, fraud * 100.0 / n).otherwise(F.lit(0.0))).alias("fraud_rate_pct"),
        (n - fraud).cast("bigint").alias("n_normal"),
        F.lit(len(df.columns)).cast("int").alias("n_columns"))


def class_counts(df: DataFrame, label: str = "class") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, label: str = "class", severe_below: float = 0.01) -> DataFrame:
    """min/max class count when exactly two classes are present."""
    cc = class_counts(df, label)
    return cc.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.when(F.count(F.lit(1)) == 2, _dbl(F.min("n")) / _dbl(F.max("n"))).alias("imbalance_ratio"),
    ).withColumn("severe", F.coalesce((F.col("imbalance_ratio") < severe_below).cast("int"), F.lit(0)))


def majority_ratio(df: DataFrame, label: str = "class") -> DataFrame:
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.agg(neg.cast("bigint").alias("n_negative"), pos.cast("bigint").alias("n_positive"),
                  F.when(pos > 0, _dbl(neg) / _dbl(pos)).alias("majority_ratio"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_count) for columns with at least one NULL (or NaN)."""
    cols = list(columns or df.columns)
    dtypes = dict(df.dtypes)

    def is_missing(c):
        m = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return m
    wide = df.agg(*[F.sum(is_missing(c).cast("bigint")).alias(c) for c in cols])
    return unpivot_wide(wide, cols, "column_name", "null_count", "bigint").where(
        F.col("null_count") > 0)


def unpivot_wide(wide: DataFrame, cols: Sequence[str], name_col: str, value_col: str,
                 cast: str = "double") -> DataFrame:
    """One-row wide aggregate -> long (name, value) rows via ``stack``."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as {cast})" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as ({name_col}, {value_col})")


def count_distinct_countries(ranges: DataFrame, data: DataFrame, range_country: str = "country",
                             data_country: str = "ip_country",
                             flag: str = "is_high_risk_country") -> DataFrame:
    """Long form (metric, value): distinct countries in ranges / data, mapped and flagged rows."""
    r = ranges.agg(F.count_distinct(range_country).alias("n_range_countries"))
    d = data.agg(F.count_distinct(data_country).alias("n_data_countries"),
                 F.count(data_country).alias("n_mapped"),
                 F.sum(F.coalesce(F.col(flag), F.lit(0))).cast("bigint").alias("n_flagged"))
    return (unpivot_wide(r, ["n_range_countries"], "metric", "value", "bigint")
            .unionByName(unpivot_wide(d, ["n_data_countries", "n_mapped", "n_flagged"],
                                      "metric", "value", "bigint")))


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True,
             accuracy: int = 100_000) -> DataFrame:
    """count/mean/std(sample)/min/q25/q50/q75/max per column, long form.

    Quartiles are exact (linear interpolation, equal to pandas) via
    distributed histogram refinement; ``exact=False`` uses
    ``percentile_approx`` with a sketch bounded by ``accuracy``.
    """
    probs = [0.25, 0.5, 0.75]
    if exact:
        from riskloom.operators.quantiles import exact_quantiles
        qs = exact_quantiles(df, list(columns), probs)
        qcol = {c: F.array(*[F.lit(v).cast("double") for v in qs.get(("", c), [None] * 3)])
                for c in columns}
    else:
        qcol = {c: F.percentile_approx(_dbl(c), probs, accuracy) for c in columns}
    aggs = []
    for c in columns:
        x = _dbl(c)
        aggs.append(F.struct(
            F.count(x).alias("count"),
            # exact decimal sum, one IEEE division: independent of summation order
            (F.sum(x.cast("decimal(38,6)")).cast("double") / F.count(x)).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), qcol[c].alias("q"), F.max(x).alias("max")).alias(c))
    wide = df.agg(*aggs)
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in columns])).alias("r"))
    return rows.select(
        F.col("r.column_name").alias("column_name"),
        F.col("r.s.count").alias("count"), F.col("r.s.mean").alias("mean"),
        F.col("r.s.std").alias("std"), F.col("r.s.min").alias("min"),
        F.col("r.s.q")[0].cast("double").alias("q25"), F.col("r.s.q")[1].cast("double").alias("q50"),
        F.col("r.s.q")[2].cast("double").alias("q75"), F.col("r.s.max").alias("max"))


def corr_with_label(df: DataFrame, columns: Sequence[str], label: str = "class",
                    top: int | None = 15) -> DataFrame:
    """|Pearson(c, label)| per column, descending; label excluded by name."""
    cols = [c for c in columns if c != label]
    wide = df.agg(*[F.corr(_dbl(c), _dbl(label)).alias(c) for c in cols])
    long = unpivot_wide(wide, cols, "feature", "corr").where(
        F.col("corr").isNotNull() & ~F.isnan("corr"))
    long = long.withColumn("abs_corr", F.abs("corr"))
    from pyspark.sql import Window
    # at most len(columns) rows: an unpartitioned window here is on metadata, not data
    w = Window.orderBy(F.desc("abs_corr"), F.asc("feature"))
    ranked = long.withColumn("rank", F.row_number().over(w))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked


_GRAM_PARTS = 64      # first level of the sums, so no group holds a row of every task


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full Pearson matrix in long form (col_a, col_b, corr), over the rows in
    which both columns have a value; NULL where fewer than two are left or one
    of the columns doesn't vary there.  NaN is no value.

    One pass: every task adds up its rows' Gram matrices (counts, sums and
    products over the rows that both columns have, by matrix products over
    blocks of rows) and gives one row per column with arrays over the others;
    these are added in two levels.  Plan and expressions don't grow with the
    columns.  Values are taken relative to the first row's, so large offsets
    cost no digits."""
    cols = list(columns)
    x = [_dbl(c) for c in cols]
    # any value near the column's will do as origin; the first makes a constant column exactly 0
    first = df.agg(*[F.first(F.when(~F.isnan(v), v), ignorenulls=True).alias(f"o{i}") for i, v in enumerate(x)]).first()
    origin = np.array([0.0 if v is None else v for v in first])
    rows = df.select(*[v.alias(f"c{i}") for i, v in enumerate(x)])
    schema = "part int, i int, n array<double>, sx array<double>, sxx array<double>, sxy array<double>"
    names = ["part", "i", "n", "sx", "sxx", "sxy"]

    def gram(batches):
        p = len(origin)
        total = np.zeros((4, p, p))
        for b in batches:
            v = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]).astype(np.float64) - origin
            has = ~np.isnan(v)
            v, h = np.where(has, v, 0.0), has.astype(np.float64)
            total += np.stack((h.T @ h, v.T @ h, (v * v).T @ h, v.T @ v))     # [i, j]: of column i where j has a value
        part = TaskContext.get().partitionId() % _GRAM_PARTS
        yield pa.RecordBatch.from_arrays([pa.array([part] * p, pa.int32()), pa.array(range(p), pa.int32()),
                                          *[pa.array(list(m), pa.list_(pa.float64())) for m in total]], names)

    def add(t: pa.Table) -> pa.Table:
        sums = [pa.array([np.sum([np.asarray(r) for r in t.column(c).to_pylist()], axis=0)], pa.list_(pa.float64())) for c in names[2:]]
        return pa.table(dict(zip(names, [t.column("part")[:1], t.column("i")[:1], *sums])))
    parts = rows.mapInArrow(gram, schema).groupBy("part", "i").applyInArrow(add, schema)
    sums = parts.groupBy("i").applyInArrow(add, schema)
    cells = sums.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy")).alias("j", "s")).select("i", "j", "s.*")
    # the other column's sums are in the transposed cell
    other = cells.select(F.col("i").alias("_j"), F.col("j").alias("_i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = cells.join(other, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))
    n = F.when(F.col("n") > 1, F.col("n"))
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    corr = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.when((vx > 0) & (vy > 0), F.sqrt(vx * vy)))
    name = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(name, F.col("i")).alias("col_a"), F.get(name, F.col("j")).alias("col_b"), corr.alias("corr"))


def box_stats(df: DataFrame, value: str, by: str = "class") -> DataFrame:
    """min, Q1, median, Q3, max of ``value`` per group (exact quartiles)."""
    from riskloom.operators.quantiles import exact_quantiles
    qs = exact_quantiles(df, [value], [0.25, 0.5, 0.75], by=by)
    q = df.sparkSession.createDataFrame(
        [(g, *v) for (g, _c), v in qs.items()], "_g string, q1 double, median double, q3 double")
    mm = df.groupBy(by).agg(F.min(_dbl(value)).alias("min"), F.max(_dbl(value)).alias("max"))
    # one row per group on both sides
    out = mm.join(q, F.col(by).cast("string") == F.col("_g"), "left")
    return out.select(by, "min", "q1", "median", "q3", "max")


def histogram_by_group(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Equal-width bins spanning each group's own [min, max]; last bin closed.

    All ``bins`` bins are returned per group (zero counts included).  The
    per-group ranges table has one row per group; bins are generated from it,
    counted rows are (group, bin) partial aggregates.
    """
    x = _dbl(value)
    rng = df.where(x.isNotNull()).groupBy(by).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    rng = rng.withColumn("_w", width)
    idx = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_mn")) / F.col("_w")), F.lit(bins - 1))).cast("int")
    counts = (df.where(x.isNotNull()).join(rng, by)
              .groupBy(by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(by, "_mn", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [by, "bin"], "left")
    return out.select(
        by, "bin",
        (F.col("_mn") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_mn") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def histogram_fixed(df: DataFrame, value: str, lo: float = 0.0, hi: float = 1.0,
                    bins: int = 50) -> DataFrame:
    """Histogram over a fixed [lo, hi] range (scores), all bins returned."""
    x = _dbl(value)
    width = (hi - lo) / bins
    idx = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(0)),
                  F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def amount_over_time(df: DataFrame, seconds: str = "Time", amount: str = "Amount",
                     label: str = "class") -> DataFrame:
    return (df.groupBy(F.floor(_dbl(seconds) / 3600.0).cast("bigint").alias("hour"), label)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(_dbl(amount)).alias("total_amount"),
                 F.max(_dbl(amount)).alias("max_amount")))


def batch_summary(scored: DataFrame, flag: str = "is_fraud") -> DataFrame:
    n = F.count(F.lit(1))
    fr = F.coalesce(F.sum(F.col(flag)), F.lit(0))
    return scored.agg(n.alias("total_transactions"), fr.cast("bigint").alias("fraud_detected"),
                      F.when(n > 0, _dbl(fr) * 100.0 / n).otherwise(F.lit(0.0)).alias("fraud_percentage"))


def risk_counts(scored: DataFrame, level: str = "risk_level") -> DataFrame:
    return scored.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def schema_of(cols: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])
