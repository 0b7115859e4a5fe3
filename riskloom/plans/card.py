"""Card-transaction feature plans.

Fitting is one global aggregate (partial per partition, one row to the
driver); transforming is a pure projection with the fitted moments as
literals, so it stays inside whole-stage codegen and never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S


@dataclass(frozen=True)
class CardState:
    """Population moments of Time and Amount (z-score with a zero std -> 1)."""
    time_mean: float | None = None
    time_std: float | None = None
    amount_mean: float | None = None
    amount_std: float | None = None


def fit_card_state(df: DataFrame) -> CardState:
    aggs = []
    for c in ("Time", "Amount"):
        if c in df.columns:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    if not aggs:
        return CardState()
    row = df.agg(*aggs).first().asDict()
    return CardState(row.get("Time_mean"), row.get("Time_std"),
                     row.get("Amount_mean"), row.get("Amount_std"))


def scale_columns(df: DataFrame, state: CardState) -> DataFrame:
    cols = []
    if "Time" in df.columns:
        if state.time_mean is None:
            raise RuntimeError("card state is not fitted for Time")
        cols.append(S.zscore("Time", state.time_mean, state.time_std).alias("scaled_time"))
    if "Amount" in df.columns:
        if state.amount_mean is None:
            raise RuntimeError("card state is not fitted for Amount")
        cols.append(S.zscore("Amount", state.amount_mean, state.amount_std).alias("scaled_amount"))
    return df.select("*", *cols)


def v_interactions(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` columns starting with 'V' (column order) times scaled_amount."""
    if "scaled_amount" not in df.columns:
        return df
    vs = [c for c in df.columns if c.startswith("V")][:n]
    return df.select("*", *[(F.col(v) * F.col("scaled_amount")).alias(f"{v}_amount_interaction")
                            for v in vs])


def engineer(df: DataFrame, state: CardState) -> DataFrame:
    """All card features (column-guarded), one projection."""
    df = scale_columns(df, state)
    extra = []
    if "Time" in df.columns:
        extra += [S.hour_fractional("Time").alias("hour"), S.day_index("Time").alias("day")]
    if "Amount" in df.columns:
        extra += [S.log1p("Amount").alias("log_amount"),
                  S.amount_category("Amount").alias("amount_category")]
    df = df.select("*", *extra)
    return v_interactions(df)
