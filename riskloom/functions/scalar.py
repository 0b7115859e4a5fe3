"""Scalar column expressions (all JVM-side, inside whole-stage codegen).

Every function takes and returns ``Column`` objects so Catalyst can fold,
prune and fuse them; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import (AGE_BIN_EDGES, AMOUNT_BIN_EDGES, INSTANT_PURCHASE_HOURS,
                             QUICK_PURCHASE_HOURS, RISK_CUTS)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- time -----

def parse_ts(col) -> Column:
    """Text or timestamp -> TIMESTAMP_NTZ; unparsable text -> NULL (caller rejects)."""
    return F.try_to_timestamp(_c(col).cast("string")).cast("timestamp_ntz")


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return F.coalesce(F.weekday(_c(ts)).isin(5, 6).cast("int"), F.lit(0))


def day_of_month(ts) -> Column:
    return F.dayofmonth(_c(ts))


def month(ts) -> Column:
    return F.month(_c(ts))


def hours_between(start, end) -> Column:
    """Signed (end - start) in hours, exact to the microsecond, time-zone free."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / 3.6e9


def velocity_minutes(hours) -> Column:
    return _c(hours) * 60.0


def quick_purchase(hours) -> Column:
    return F.coalesce((_c(hours) < QUICK_PURCHASE_HOURS).cast("int"), F.lit(0))


def instant_purchase(hours) -> Column:
    return F.coalesce((_c(hours) < INSTANT_PURCHASE_HOURS).cast("int"), F.lit(0))


def hour_fractional(seconds) -> Column:
    """(Time / 3600) mod 24 with a non-negative remainder."""
    return F.pmod(_c(seconds) / 3600.0, F.lit(24.0))


def day_index(seconds) -> Column:
    """int(Time / 86400): truncation toward zero."""
    return (_c(seconds) / 86400.0).cast("int")


def request_times(hour, dow, hours_since_signup, base_date) -> tuple[Column, Column]:
    """Purchase/signup timestamps for a request given hour, weekday and gap.

    Purchase = ``base_date`` at ``hour``:00, moved forward to the next day
    whose weekday (Monday = 0) equals ``dow``; signup = purchase - gap hours,
    truncated to whole seconds.  ``base_date`` is a column or 'YYYY-MM-DD'.
    """
    base = F.to_date(F.lit(base_date)) if isinstance(base_date, str) else _c(base_date)
    shift = F.pmod(_c(dow) - F.weekday(base), F.lit(7))
    day = F.date_add(base, shift.cast("int"))
    purchase = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day),
                                    _c(hour), F.lit(0), F.lit(0))
    gap_us = (_c(hours_since_signup) * 3.6e9).cast("bigint")
    signup_us = F.unix_micros(purchase.cast("timestamp")) - gap_us
    signup_s = F.floor(signup_us / 1_000_000).cast("bigint")
    signup = F.timestamp_seconds(signup_s).cast("timestamp_ntz")
    return purchase, signup


# ---------------------------------------------------------------- value ----

def log1p(col) -> Column:
    """ln(1 + x); NULL for x <= -1 (numpy would give -inf / NaN)."""
    return F.log1p(_c(col))


def is_round_value(col) -> Column:
    return F.coalesce((_c(col) % 1 == 0).cast("int"), F.lit(0))


def right_closed_bins(col, edges: Sequence[float], below_first: bool = False,
                      above_last: bool = False) -> Column:
    """Codes for right-closed bins (e0,e1], (e1,e2], ...; outside/NULL -> -1.

    ``below_first`` opens the first bin to -inf, ``above_last`` adds a final
    (e_last, +inf) bin.  ``Bucketizer`` is left-closed, hence this chain.
    """
    x = _c(col)
    out = None
    code = 0
    if below_first:
        out = F.when(x <= edges[0], F.lit(code))
        code += 1
        pairs = list(zip(edges[:-1], edges[1:]))
    else:
        pairs = list(zip(edges[:-1], edges[1:]))
    for lo, hi in pairs:
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
        code += 1
    if above_last:
        out = out.when(x > edges[-1], F.lit(code))
    return out.otherwise(F.lit(-1))


def age_group(col) -> Column:
    return right_closed_bins(col, AGE_BIN_EDGES)


def amount_category(col) -> Column:
    return right_closed_bins(col, AMOUNT_BIN_EDGES, below_first=True, above_last=True)


# -------------------------------------------------------------- strings ----

def browser_source(browser="browser", source="source") -> Column:
    """browser || '_' || source; NULL when either side is NULL."""
    return F.concat(_c(browser), F.lit("_"), _c(source))


def ip_to_int(col) -> Column:
    """Dotted quad -> integer by shifts; any malformed input -> 0.

    Octets above 255 are accepted and parts beyond the fourth ignored,
    matching a plain ``a<<24 + b<<16 + c<<8 + d`` parse.
    """
    parts = F.split(_c(col).cast("string"), r"\.", -1)
    octs = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    val = (F.shiftleft(octs[0], 24) + F.shiftleft(octs[1], 16)
           + F.shiftleft(octs[2], 8) + octs[3])
    return F.coalesce(val, F.lit(0).cast("bigint"))


def ip_numeric(col) -> Column:
    """Numeric IP (float holding an integer): NULL -> 0, truncate to int64."""
    return F.coalesce(_c(col).cast("bigint"), F.lit(0).cast("bigint"))


def ip_as_int(col, data_type) -> Column:
    """Dispatch on the source type: numeric IPs truncate, text IPs parse."""
    from pyspark.sql.types import StringType
    return ip_to_int(col) if isinstance(data_type, StringType) else ip_numeric(col)


def int_to_dotted(col) -> Column:
    x = _c(col)
    return F.concat_ws(".", F.shiftright(x, 24) % 256, F.shiftright(x, 16) % 256,
                       F.shiftright(x, 8) % 256, x % 256)


# ------------------------------------------------------------- encoding ----

def one_hot(col_name: str, categories: Sequence[str], drop_first: bool = True) -> list[Column]:
    """Integer indicator per fitted category (sorted, first dropped); NULL -> all 0."""
    cats = sorted(c for c in categories if c is not None)
    if drop_first:
        cats = cats[1:]
    x = F.col(col_name)
    return [F.coalesce((x == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col_name}_{v}")
            for v in cats]


def with_defaults(df, defaults: Mapping[str, object]):
    """Template values for absent or NULL request columns."""
    for name, value in defaults.items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
        else:
            df = df.withColumn(name, F.lit(value))
    return df


# Template record for a request with absent columns.
REQUEST_DEFAULTS = {
    "user_id": 0,
    "purchase_value": 0.0,
    "device_id": "unknown_device",
    "source": "Direct",
    "browser": "Chrome",
    "sex": "M",
    "age": 0,
    "ip_address": "0.0.0.0",
    "class": 0,
    "ip_country": "United States",
    "is_high_risk_country": 0,
}


# --------------------------------------------------------------- scoring ---

def confidence(p) -> Column:
    return F.greatest(_c(p), 1.0 - _c(p))


def is_fraud(p, threshold: float = 0.5) -> Column:
    return (_c(p) >= F.lit(float(threshold))).cast("int")


def risk_level(p) -> Column:
    lo, mid, hi = RISK_CUTS
    x = _c(p)
    return (F.when(x < lo, "low").when(x < mid, "medium")
            .when(x < hi, "high").otherwise("critical"))


def zscore(col, mean, std) -> Column:
    """(x - mean) / std with a zero (or NULL) std treated as 1."""
    safe = F.when(F.coalesce(F.lit(std), F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(F.lit(std))
    return (_c(col) - F.lit(mean)) / safe
