"""Model-matrix preparation: stratified split, median imputation, standard
scaling, class weights.

Fitted state is small (one number per column or per class) and becomes
literals in the transform projection, like any Spark ML ``Model``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPLIT_BUCKET_HEX = 4  # 16**4 = 65,536 hash buckets per class


# --------------------------------------------------------------- split -----

def split_hash(key: str, seed: int) -> Column:
    """Deterministic per-row order: md5 of '<key>:<seed>' (equal on Spark and DuckDB)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, label: str = "class", key: str = "txn_id",
                     test_size: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Exact stratified split: per class the first round(test_size * n_c) rows
    in (md5, key) order are test rows (``out`` = 1), the rest train.

    A ``row_number`` per class would send a whole class (the majority is
    most of the data) to one task.  Instead rows are counted per (class,
    md5-prefix bucket) - at most 2 x 65,536 rows, broadcast - the cut bucket
    of each class is found from cumulative bucket counts, and only rows of
    that one bucket per class are ranked inside a window.
    """
    h = split_hash(key, seed)
    b = F.conv(F.substring(h, 1, _SPLIT_BUCKET_HEX), 16, 10).cast("int")
    rows = df.withColumn("_h", h).withColumn("_b", b)
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy(label)
    upto = per_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # windows over the bucket-count table only (<= 65,536 rows per class)
    status = counts.select(
        label, "_b",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_through"),
        F.floor(F.sum("_n").over(per_class) * F.lit(float(test_size)) + F.lit(0.5)).alias("_k"))
    status = status.select(
        label, "_b", "_before", "_k",
        F.when(F.col("_through") <= F.col("_k"), F.lit(1))
         .when(F.col("_before") >= F.col("_k"), F.lit(0))
         .otherwise(F.lit(-1)).alias("_full"))
    joined = rows.join(F.broadcast(status), [label, "_b"])
    decided = joined.where(F.col("_full") >= 0).withColumn(out, F.col("_full"))
    cut = joined.where(F.col("_full") < 0)
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    cut = cut.withColumn(out, (F.col("_before") + rank <= F.col("_k")).cast("int"))
    keep = [*df.columns, out]
    return decided.select(*keep).unionByName(cut.select(*keep))


# ----------------------------------------------------------- imputation ----

@dataclass
class ImputeState:
    medians: dict = field(default_factory=dict)


def fit_medians(df: DataFrame, columns: Sequence[str], exact: bool = True,
                accuracy: int = 100_000) -> ImputeState:
    """Median per column (pandas-style: mean of the two middle values).

    ``exact`` finds the middle order statistics by distributed histogram
    refinement (``quantiles.exact_quantiles``: a few scans, no whole-column
    buffer); ``exact=False`` uses ``percentile_approx`` with a bounded sketch.
    """
    if not columns:
        return ImputeState()
    if exact:
        from riskloom.operators.quantiles import exact_medians
        med = exact_medians(df, list(columns))
        return ImputeState({c: (float(med[c]) if med[c] is not None else None) for c in columns})
    aggs = [F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in columns]
    row = df.agg(*aggs).first().asDict()
    return ImputeState({c: (float(row[c]) if row[c] is not None else None) for c in columns})


def apply_medians(df: DataFrame, state: ImputeState, fill_rest: float = 0.0) -> DataFrame:
    """NULL -> fitted median; columns whose median is NULL (all NULL) -> ``fill_rest``."""
    cols = []
    for c in df.columns:
        if c in state.medians:
            m = state.medians[c]
            cols.append(F.coalesce(F.col(c), F.lit(m if m is not None else fill_rest)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# -------------------------------------------------------------- scaling ----

@dataclass
class ScaleState:
    columns: list = field(default_factory=list)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)

    @property
    def fitted(self) -> bool:
        return bool(self.columns)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> ScaleState:
    """Mean and population std per column in one aggregate (one row fetched)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first().asDict()
    return ScaleState(list(columns), {c: row[f"m_{c}"] for c in columns},
                      {c: row[f"s_{c}"] for c in columns})


def apply_scaler(df: DataFrame, state: ScaleState) -> DataFrame:
    """(x - mean) / std; a zero or NULL std divides by 1."""
    if not state.fitted:
        raise RuntimeError("scaler must be fitted before transform")
    out = []
    for c in df.columns:
        if c in state.means:
            m, s = state.means[c], state.stds[c]
            m = 0.0 if m is None else float(m)
            s = 1.0 if (s is None or s == 0.0) else float(s)
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def state_table(spark, impute: ImputeState, scale: ScaleState) -> DataFrame:
    """Fitted state as a small table (column order kept in ``position``)."""
    rows = [(i, c, impute.medians.get(c), scale.means.get(c), scale.stds.get(c))
            for i, c in enumerate(scale.columns)]
    return spark.createDataFrame(
        rows, "position int, column_name string, median double, mean double, std double")


# --------------------------------------------------------- class weight ----

def class_weights(df: DataFrame, label: str = "class") -> DataFrame:
    """'balanced' weight per class: n / (k * n_c) over the (tiny) class-count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(label, (F.sum("_n").over(whole).cast("double")
                                 / (F.count(F.lit(1)).over(whole) * F.col("_n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "class", out: str = "weight",
                      positive_weight: float | None = None) -> DataFrame:
    """Attach a per-row weight; ``positive_weight`` fixes the class-1 weight
    (boosted-tree ``scale_pos_weight``) and leaves class 0 at 1."""
    if positive_weight is not None:
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(positive_weight)))
                             .otherwise(F.lit(1.0)))
    w = class_weights(df, label).withColumnRenamed("weight", out)
    return df.join(F.broadcast(w), label, "left")
