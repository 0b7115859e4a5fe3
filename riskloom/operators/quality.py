"""Data-quality checks, validation with reject reasons, and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_not_empty(df: DataFrame, what: str = "dataset") -> DataFrame:
    """Raise ValueError on an empty table (a LIMIT 1 job, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def emptiness_report(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), (n > 0).cast("int").alias("not_empty"))


def _rule(cond: Column, reason: str) -> Column:
    """Reason string when ``cond`` (the failure) holds, else NULL."""
    return F.when(cond, F.lit(reason))


def validate(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Append ``is_valid`` (0/1) and ``reject_reason`` ('; '-joined, NULL when valid)."""
    reasons = F.array_compact(F.array(*[_rule(c, r) for c, r in rules]))
    return (df.withColumn("_reasons", reasons)
            .withColumn("is_valid", (F.size("_reasons") == 0).cast("int"))
            .withColumn("reject_reason", F.when(F.size("_reasons") > 0,
                                                F.array_join("_reasons", "; ")))
            .drop("_reasons"))


def commerce_rules(df: DataFrame) -> list[tuple[Column, str]]:
    """Request-style range rules; the optional fields are checked only if present."""
    rules = [
        (F.col("purchase_value").isNull(), "purchase_value missing"),
        (F.col("purchase_value") <= 0, "purchase_value must be > 0"),
        (F.col("age").isNull(), "age missing"),
        ((F.col("age") < 18) | (F.col("age") > 120), "age must be in [18, 120]"),
    ]
    if "hour_of_day" in df.columns:
        rules.append(((F.col("hour_of_day") < 0) | (F.col("hour_of_day") >= 24),
                      "hour_of_day must be in [0, 24)"))
    if "day_of_week" in df.columns:
        rules.append(((F.col("day_of_week") < 0) | (F.col("day_of_week") >= 7),
                      "day_of_week must be in [0, 7)"))
    if "time_since_signup_hours" in df.columns:
        rules.append((F.col("time_since_signup_hours") < 0, "time_since_signup_hours must be >= 0"))
    return [(F.coalesce(c, F.lit(False)), r) for c, r in rules]


def card_rules(df: DataFrame) -> list[tuple[Column, str]]:
    rules = [
        (F.col("Time").isNull(), "Time missing"),
        (F.col("Amount").isNull(), "Amount missing"),
        (F.col("Amount") < 0, "Amount must be >= 0"),
    ]
    return [(F.coalesce(c, F.lit(False)), r) for c, r in rules]


def card_defaults(df: DataFrame, v_columns: Sequence[str]) -> DataFrame:
    """V1..V28 default to 0.0 when absent or NULL."""
    out = df
    for v in v_columns:
        out = out.withColumn(v, F.coalesce(F.col(v).cast("double"), F.lit(0.0))
                             if v in df.columns else F.lit(0.0))
    return out


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def keep_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature list order; missing -> 0, extra dropped (``keep`` columns pass through)."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep if k in present]
    for f in features:
        cols.append(F.col(f).cast("double").alias(f) if f in present else F.lit(0.0).alias(f))
    return df.select(*cols)
