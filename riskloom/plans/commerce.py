"""E-commerce purchase feature plans.

``engineer`` builds every feature of the purchase table as one lazy plan:
scalar columns (codegen), per-key aggregates attached back (partial agg +
join), skew-safe velocity windows, the IP-range as-of join and the learned
high-risk-country flag.  Category lists and the country set are *fitted*
state, so the output schema never depends on the batch being transformed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import CATEGORICAL_COLUMNS, HIGH_RISK_MIN_COUNT, HIGH_RISK_RATE
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as A
from riskloom.operators.asof import asof_range_join
from riskloom.operators.velocity import key_velocity_auto, largest_groups

IP_LOWER = "lower_bound_ip_address"
IP_UPPER = "upper_bound_ip_address"


def with_ip_int(df: DataFrame, ip: str = "ip_address", out: str = "ip_as_int") -> DataFrame:
    return df.withColumn(out, S.ip_as_int(ip, df.schema[ip].dataType))


def country_index(ranges: DataFrame, out: str = "ip_country"):
    """Reusable as-of index over the IP ranges (built once, joined many times)."""
    from riskloom.operators.asof import RangeIndex
    return RangeIndex(ranges.select(IP_LOWER, IP_UPPER, F.col("country").alias(out)),
                      IP_LOWER, IP_UPPER, [out])


def with_country(df: DataFrame, ranges, ip: str = "ip_address",
                 out: str = "ip_country") -> DataFrame:
    """IP -> country by the nearest-lower as-of rule with the upper-bound check.

    ``ranges`` is the range table or a prebuilt :func:`country_index`."""
    if "ip_as_int" not in df.columns:
        df = with_ip_int(df, ip)
    if not isinstance(ranges, DataFrame):
        return ranges.join(df, "ip_as_int")
    r = ranges.select(IP_LOWER, IP_UPPER, F.col("country").alias(out))
    return asof_range_join(df, "ip_as_int", r, IP_LOWER, IP_UPPER, [out])


def time_features(df: DataFrame, ts: str = "purchase_time", signup: str = "signup_time") -> DataFrame:
    cols = []
    if ts in df.columns:
        cols += [S.hour_of_day(ts).alias("hour_of_day"), S.day_of_week(ts).alias("day_of_week"),
                 S.is_weekend(ts).alias("is_weekend"), S.day_of_month(ts).alias("day_of_month"),
                 S.month(ts).alias("month")]
    df = df.select("*", *cols)
    if ts in df.columns and signup in df.columns:
        h = S.hours_between(signup, ts)
        df = (df.withColumn("time_since_signup_hours", h)
              .withColumn("purchase_velocity_minutes", S.velocity_minutes("time_since_signup_hours"))
              .withColumn("quick_purchase", S.quick_purchase("time_since_signup_hours"))
              .withColumn("instant_purchase", S.instant_purchase("time_since_signup_hours")))
    return df


def value_features(df: DataFrame) -> DataFrame:
    if "purchase_value" in df.columns:
        df = (df.withColumn("log_purchase_value", S.log1p("purchase_value"))
              .withColumn("purchase_value_rounded", S.is_round_value("purchase_value")))
    if "age" in df.columns:
        df = df.withColumn("age_group", S.age_group("age"))
    if "browser" in df.columns and "source" in df.columns:
        df = df.withColumn("browser_source", S.browser_source())
    return df


@dataclass
class CommerceState:
    """Fitted state of the purchase feature build (all small)."""
    categories: dict = field(default_factory=dict)  # column -> sorted category list
    high_risk: DataFrame | None = None  # one column ip_country
    global_rate: float | None = None


def fit_state(df: DataFrame, label: str = "class", min_rate: float = HIGH_RISK_RATE,
              min_count: int | None = HIGH_RISK_MIN_COUNT) -> CommerceState:
    """Fit category lists and the high-risk country set on (training) rows.

    Category lists are distinct values of low-cardinality columns (a bounded
    fetch); the country set stays a DataFrame.
    """
    state = CommerceState()
    present = [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    if present:
        # one pass over the data; result rows = number of distinct values
        rows = (df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in present]))
            .alias("x")).where(F.col("x.v").isNotNull()).select("x.c", "x.v").distinct().collect())
        for c in present:
            state.categories[c] = sorted(r["v"] for r in rows if r["c"] == c)
    if "ip_country" in df.columns and label in df.columns:
        stats = A.country_stats_fit(df, "ip_country", label)
        state.high_risk = A.high_risk_set(stats, "ip_country", min_rate, min_count)
    return state


def engineer(df: DataFrame, state: CommerceState, ranges: DataFrame | None = None,
             ip_key: str = "ip_address", order_col: str = "txn_id",
             materialize: bool = True, history=None) -> DataFrame:
    """All purchase features; column-guarded like the modelled feature step.

    With ``history`` (``keystate.KeyState``) the per-key counts are those of
    everything the state has seen and ``df``; else those of ``df`` alone.

    About a dozen branches (group aggregates, velocity windows and their
    offsets, halos, probes) read the input; ``materialize`` writes it once
    to the shared checkpoint folder so they scan that instead of each
    recomputing the upstream joins.  Pass ``False`` for an input that is
    already materialised (a checkpoint, a table) or tiny (a micro-batch).
    """
    if ranges is not None and "ip_address" in df.columns and "ip_country" not in df.columns:
        df = with_country(df, ranges)
    if materialize:
        from riskloom.session import cut_lineage
        df = cut_lineage(df)
    base = df
    df = time_features(df)
    if history is not None:
        df = history.features(df)
    if history is None and "device_id" in df.columns:
        aggs = {"device_frequency": F.count(F.lit(1))}
        if "user_id" in df.columns:
            aggs["users_per_device"] = F.count_distinct("user_id")
        df = A.attach_group_aggs(df, "device_id", aggs)
    if history is None and ip_key in df.columns:
        aggs = {"ip_frequency": F.count(F.lit(1))}
        if "user_id" in df.columns:
            aggs["users_per_ip"] = F.count_distinct("user_id")
        df = A.attach_group_aggs(df, ip_key, aggs)
    if "ip_address" in df.columns and "ip_as_int" not in df.columns:
        df = with_ip_int(df)
    df = value_features(df)
    if history is None and "purchase_time" in df.columns:
        vkeys = [k for k in ("device_id", ip_key) if k in df.columns]
        # one skew probe for both keys, on the input before the feature joins
        largest = largest_groups(base, vkeys, "purchase_time") if vkeys else {}
        if "device_id" in df.columns:
            df = key_velocity_auto(df, "device_id", "purchase_time", order_col,
                                   largest=largest["device_id"],
                                   count_col="user_id" if "user_id" in df.columns else order_col,
                                   usage_out="device_usage_count", freq_out="device_freq_1h")
        if ip_key in df.columns:
            df = key_velocity_auto(df, ip_key, "purchase_time", order_col, largest=largest[ip_key],
                                   usage_out="ip_usage_count")
    if "ip_country" in df.columns:
        if state.high_risk is not None:
            df = A.flag_in_set(df, "ip_country", state.high_risk, "ip_country", "is_high_risk_country")
        else:
            df = df.withColumn("is_high_risk_country", F.lit(0))
    for c, cats in state.categories.items():
        if c in df.columns:
            df = df.select(*[x for x in df.columns if x != c], *S.one_hot(c, cats))
    return df
