"""Registered queries: scalar feature functions, data quality and projections.

Each key projects one feature (or one check) over a whole derived table, so
the plan is a single scan + codegen projection; DuckDB statements compute
the same expressions independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import COMMERCE_DROP_COLUMNS
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as A
from riskloom.operators import quality as Q
from riskloom.plans import commerce as C
from riskloom.plans.catalog import commerce_geo, query, r6
from riskloom.plans.oracle import sql
from riskloom.sources import fixtures as X
from riskloom.sources.schemas import V_COLUMNS

# ============================================================ scalars =======


def _commerce_feature(key, make, sql_expr, typ=None, exact=False):
    """Register ``txn_id, <key without f_>`` over the purchase table.

    ``exact`` leaves a double unrounded: both engines compute it with the
    same IEEE operations, and values on a half-way point round differently.
    """
    name = key[2:]

    def run(spark, d):
        t = X.commerce_txn(spark, d)
        c = make(t)
        if typ:
            c = c.cast(typ)
        return r6(t.select("txn_id", c.alias(name)), exact=(name,) if exact else ())
    query(key)(run)
    sql(key, f"select txn_id, {sql_expr} as {name} from commerce_txn", "commerce_txn")


_HOURS_SQL = "(cast(epoch_us(purchase_time) - epoch_us(signup_time) as double) / cast(3.6e9 as double))"

_commerce_feature("f_hour_of_day", lambda t: S.hour_of_day("purchase_time"),
                  "cast(hour(purchase_time) as int)", "int")
_commerce_feature("f_day_of_week", lambda t: S.day_of_week("purchase_time"),
                  "cast(isodow(purchase_time) - 1 as int)", "int")
_commerce_feature("f_is_weekend", lambda t: S.is_weekend("purchase_time"),
                  "cast(isodow(purchase_time) in (6, 7) as int)", "int")
_commerce_feature("f_day_of_month", lambda t: S.day_of_month("purchase_time"),
                  "cast(day(purchase_time) as int)", "int")
_commerce_feature("f_month", lambda t: S.month("purchase_time"),
                  "cast(month(purchase_time) as int)", "int")
_commerce_feature("f_time_since_signup_hours",
                  lambda t: S.hours_between("signup_time", "purchase_time"),
                  _HOURS_SQL, exact=True)
_commerce_feature("f_purchase_velocity_minutes",
                  lambda t: S.velocity_minutes(S.hours_between("signup_time", "purchase_time")),
                  f"{_HOURS_SQL} * cast(60.0 as double)", exact=True)
_commerce_feature("f_quick_purchase",
                  lambda t: S.quick_purchase(S.hours_between("signup_time", "purchase_time")),
                  f"coalesce(cast({_HOURS_SQL} < 1.0 as int), 0)", "int")
_commerce_feature("f_instant_purchase",
                  lambda t: S.instant_purchase(S.hours_between("signup_time", "purchase_time")),
                  f"coalesce(cast({_HOURS_SQL} < 0.0833 as int), 0)", "int")
_commerce_feature("f_log_purchase_value", lambda t: S.log1p("purchase_value"),
                  "round(ln(1 + purchase_value), 6)")
_commerce_feature("f_purchase_value_rounded", lambda t: S.is_round_value("purchase_value"),
                  "coalesce(cast(purchase_value % 1 = 0 as int), 0)", "int")
_commerce_feature("f_age_group", lambda t: S.age_group("age"), """case
  when age > 0 and age <= 18 then 0 when age > 18 and age <= 25 then 1
  when age > 25 and age <= 35 then 2 when age > 35 and age <= 45 then 3
  when age > 45 and age <= 55 then 4 when age > 55 and age <= 65 then 5
  when age > 65 and age <= 100 then 6 else -1 end""", "int")
_commerce_feature("f_browser_source", lambda t: S.browser_source(),
                  "browser || '_' || source")
_commerce_feature("f_ip_numeric", lambda t: S.ip_numeric("ip_address"),
                  "coalesce(cast(floor(ip_address) as bigint), 0)", "bigint")


@query("f_parse_ts")
def f_parse_ts(spark, d):
    """Text timestamps (every 29th row malformed) -> TIMESTAMP_NTZ + reject flag."""
    t = X.commerce_txn(spark, d)
    text = F.when(F.col("txn_id") % 29 == 0, F.lit("not a time")).otherwise(
        F.col("purchase_time").cast("string"))
    ts = S.parse_ts(text)
    return t.select("txn_id", ts.alias("parsed_time"),
                    ts.isNull().cast("int").alias("parse_failed"))


sql("f_parse_ts", """
select txn_id, parsed_time, cast(parsed_time is null as int) as parse_failed from (
  select txn_id, try_cast(case when txn_id % 29 = 0 then 'not a time'
                               else cast(purchase_time as varchar) end as timestamp) as parsed_time
  from commerce_txn)""", "commerce_txn")


def _ip_text(t):
    """Dotted text IPs with malformed variants: extra part, junk, octet > 255, NULL."""
    dotted = S.int_to_dotted(S.ip_numeric("ip_address"))
    tid = F.col("txn_id")
    return (F.when(F.col("ip_address").isNull(), F.lit(None).cast("string"))
            .when(tid % 11 == 0, F.concat(dotted, F.lit(".7")))
            .when(tid % 13 == 0, F.lit("n/a"))
            .when(tid % 19 == 0, F.concat(F.lit("300."), dotted))
            .otherwise(dotted))


_IP_TEXT_SQL = """
(select txn_id, case when ip_address is null then null
   when txn_id % 11 = 0 then d || '.7' when txn_id % 13 = 0 then 'n/a'
   when txn_id % 19 = 0 then '300.' || d else d end as ip_text
 from (select txn_id, ip_address,
         concat_ws('.', (ip >> 24) % 256, (ip >> 16) % 256, (ip >> 8) % 256, ip % 256) as d
       from (select *, coalesce(cast(floor(ip_address) as bigint), 0) as ip from commerce_txn)))"""


@query("f_ip_to_int")
def f_ip_to_int(spark, d):
    t = X.commerce_txn(spark, d)
    t = t.select("txn_id", "ip_address", _ip_text(t).alias("ip_text"))
    return t.select("txn_id", "ip_text", S.ip_to_int("ip_text").alias("ip_int"))


sql("f_ip_to_int", f"""
select txn_id, ip_text, coalesce((try_cast(p[1] as bigint) << 24) + (try_cast(p[2] as bigint) << 16)
                                 + (try_cast(p[3] as bigint) << 8) + try_cast(p[4] as bigint), 0) as ip_int
from (select txn_id, ip_text, string_split(ip_text, '.') as p from {_IP_TEXT_SQL})""", "commerce_txn")


@query("f_cast_bounds")
def f_cast_bounds(spark, d):
    """Range bounds arriving as fractional doubles are truncated to BIGINT."""
    r = X.ip_ranges(spark, d)
    return r.select((F.col("lower_bound_ip_address").cast("double") + 0.75).cast("bigint").alias("lo"),
                    (F.col("upper_bound_ip_address").cast("double") + 0.25).cast("bigint").alias("hi"),
                    "country")


sql("f_cast_bounds", """
select cast(floor(cast(lower_bound_ip_address as double) + 0.75) as bigint) as lo,
       cast(floor(cast(upper_bound_ip_address as double) + 0.25) as bigint) as hi, country
from ip_ranges""", "ip_ranges")


@query("f_one_hot")
def f_one_hot(spark, d):
    """Fitted sorted category lists, first category dropped, NULL -> all 0."""
    t = X.commerce_txn(spark, d)
    state = C.fit_state(t.select("browser", "source", "sex"))
    cols = [c for k in ("browser", "source", "sex") for c in S.one_hot(k, state.categories[k])]
    return t.select("txn_id", *cols)


sql("f_one_hot", """
select txn_id,
  coalesce(cast(browser = 'Firefox' as int), 0) as browser_Firefox,
  coalesce(cast(browser = 'IE' as int), 0) as browser_IE,
  coalesce(cast(browser = 'Safari' as int), 0) as browser_Safari,
  coalesce(cast(source = 'Direct' as int), 0) as source_Direct,
  coalesce(cast(source = 'SEO' as int), 0) as source_SEO,
  coalesce(cast(sex = 'M' as int), 0) as sex_M
from commerce_txn""", "commerce_txn")


@query("f_flag_high_risk")
def f_flag_high_risk(spark, d):
    g = commerce_geo(spark, d)
    state = C.fit_state(g.select("ip_country", "class"))
    return A.flag_in_set(g, "ip_country", state.high_risk, "ip_country",
                         "is_high_risk_country").select("txn_id", "is_high_risk_country")


sql("f_flag_high_risk", """
select g.txn_id, case when h.ip_country is not null then 1 else 0 end as is_high_risk_country
from commerce_geo g left join (
  select ip_country from commerce_geo where ip_country is not null
  group by ip_country having avg(class) > 0.2 and count(class) > 10) h
on g.ip_country = h.ip_country""", "commerce_geo")


@query("f_request_times")
def f_request_times(spark, d):
    """Rebuild purchase/signup times from (hour, weekday, gap) with a fixed base date."""
    t = X.commerce_txn(spark, d)
    hrs = S.hours_between("signup_time", "purchase_time")
    req = t.select("txn_id", S.hour_of_day("purchase_time").alias("h"),
                   S.day_of_week("purchase_time").alias("dow"), hrs.alias("gap"))
    p, s = S.request_times("h", "dow", "gap", "2024-03-01")
    return req.select("txn_id", p.alias("req_purchase_time"), s.alias("req_signup_time"))


sql("f_request_times", """
select txn_id, p as req_purchase_time,
       make_timestamp(cast(floor((epoch_us(p) - cast(trunc(gap * 3600000000.0) as bigint)) / 1000000.0)
                           as bigint) * 1000000) as req_signup_time
from (select txn_id, gap,
        cast(date '2024-03-01' + cast(((dow - (isodow(date '2024-03-01') - 1)) % 7 + 7) % 7 as int)
             as timestamp) + to_hours(h) as p
      from (select txn_id, hour(purchase_time) as h, isodow(purchase_time) - 1 as dow,
                   (epoch_us(purchase_time) - epoch_us(signup_time)) / 3600000000.0 as gap
            from commerce_txn))""", "commerce_txn")


@query("f_default_record")
def f_default_record(spark, d):
    """Absent/NULL request fields take the template record's values."""
    t = X.commerce_txn(spark, d).select("txn_id", "device_id", "browser", "source", "sex")
    return S.with_defaults(t, {k: S.REQUEST_DEFAULTS[k]
                               for k in ("device_id", "browser", "source", "sex", "ip_country",
                                         "is_high_risk_country")})


sql("f_default_record", """
select txn_id, coalesce(device_id, 'unknown_device') as device_id, coalesce(browser, 'Chrome') as browser,
       coalesce(source, 'Direct') as source, coalesce(sex, 'M') as sex, 'United States' as ip_country,
       0 as is_high_risk_country
from commerce_txn""", "commerce_txn")


def _card_feature(key, make, sql_expr, typ=None, view="card_txn"):
    name = key[2:]

    def run(spark, d):
        t = X.card_txn(spark, d) if view == "card_txn" else X.scores(spark, d)
        c = make(t)
        if typ:
            c = c.cast(typ)
        return r6(t.select("txn_id", c.alias(name)))
    query(key)(run)
    sql(key, f"select txn_id, {sql_expr} as {name} from {view}", view)


_card_feature("f_log_amount", lambda t: S.log1p("Amount"), 'round(ln(1 + "Amount"), 6)')
_card_feature("f_amount_category", lambda t: S.amount_category("Amount"), """case
  when "Amount" <= 10 then 0 when "Amount" > 10 and "Amount" <= 50 then 1
  when "Amount" > 50 and "Amount" <= 100 then 2 when "Amount" > 100 and "Amount" <= 500 then 3
  when "Amount" > 500 then 4 else -1 end""", "int")
_card_feature("f_hour_fractional", lambda t: S.hour_fractional("Time"),
              'round((("Time" / 3600.0) % 24 + 24) % 24, 6)')
_card_feature("f_day_index", lambda t: S.day_index("Time"), 'cast(trunc("Time" / 86400.0) as int)', "int")
_card_feature("f_confidence", lambda t: S.confidence("fraud_probability"),
              "round(greatest(fraud_probability, 1 - fraud_probability), 6)", view="scores")
_card_feature("f_is_fraud", lambda t: S.is_fraud("fraud_probability"),
              "cast(fraud_probability >= 0.5 as int)", "int", view="scores")
_card_feature("f_risk_level", lambda t: S.risk_level("fraud_probability"), """case
  when fraud_probability < 0.3 then 'low' when fraud_probability < 0.6 then 'medium'
  when fraud_probability < 0.8 then 'high' else 'critical' end""", view="scores")


def _scaled(spark, d):
    from riskloom.plans.card import fit_card_state, scale_columns
    card = X.card_txn(spark, d)
    return scale_columns(card, fit_card_state(card))


_Z = """(x - avg(x) over ()) / case when coalesce(stddev_pop(x) over (), 0) = 0 then 1
                                    else stddev_pop(x) over () end"""


@query("f_scaled_time")
def f_scaled_time(spark, d):
    return r6(_scaled(spark, d).select("txn_id", "scaled_time"))


sql("f_scaled_time", f"select txn_id, round({_Z.replace('x', chr(34) + 'Time' + chr(34))}, 6) as scaled_time "
    "from card_txn", "card_txn")


@query("f_scaled_amount")
def f_scaled_amount(spark, d):
    return r6(_scaled(spark, d).select("txn_id", "scaled_amount"))


sql("f_scaled_amount", f"select txn_id, round({_Z.replace('x', chr(34) + 'Amount' + chr(34))}, 6) "
    "as scaled_amount from card_txn", "card_txn")


@query("f_v_interactions")
def f_v_interactions(spark, d):
    from riskloom.plans.card import v_interactions
    s = _scaled(spark, d)
    return r6(v_interactions(s).select("txn_id", *[f"V{i}_amount_interaction" for i in range(1, 6)]))


_SA = _Z.replace("x", '"Amount"')
sql("f_v_interactions", "select txn_id, " + ", ".join(
    f"round(V{i} * ({_SA}), 6) as V{i}_amount_interaction" for i in range(1, 6)) + " from card_txn",
    "card_txn")

# ======================================================= data quality =======


@query("dq_not_empty")
def dq_not_empty(spark, d):
    return Q.emptiness_report(Q.ensure_not_empty(X.commerce_txn(spark, d), "purchases"))


sql("dq_not_empty", "select count(*) as n_rows, cast(count(*) > 0 as int) as not_empty from commerce_txn",
    "commerce_txn")


@query("dq_class_counts")
def dq_class_counts(spark, d):
    return A.class_counts(X.card_txn(spark, d))


sql("dq_class_counts", "select class, count(*) as n from card_txn group by class", "card_txn")


@query("dq_imbalance_ratio")
def dq_imbalance_ratio(spark, d):
    return r6(A.imbalance(X.commerce_txn(spark, d)))


sql("dq_imbalance_ratio", """
select count(*) as n_classes,
       round(case when count(*) = 2 then cast(min(n) as double) / max(n) end, 6) as imbalance_ratio,
       coalesce(cast(case when count(*) = 2 then cast(min(n) as double) / max(n) end < 0.01 as int), 0) as severe
from (select class, count(*) as n from commerce_txn group by class)""", "commerce_txn")


@query("dq_majority_ratio")
def dq_majority_ratio(spark, d):
    return r6(A.majority_ratio(X.card_txn(spark, d)))


sql("dq_majority_ratio", """
select cast(sum(case when class = 0 then 1 else 0 end) as bigint) as n_negative,
       cast(sum(case when class = 1 then 1 else 0 end) as bigint) as n_positive,
       round(case when sum(case when class = 1 then 1 else 0 end) > 0 then
         cast(sum(case when class = 0 then 1 else 0 end) as double) / sum(case when class = 1 then 1 else 0 end)
       end, 6) as majority_ratio
from card_txn""", "card_txn")


@query("dq_null_counts")
def dq_null_counts(spark, d):
    return A.null_counts(X.commerce_txn(spark, d))


_COMMERCE_COLS = ["txn_id", "user_id", "signup_time", "purchase_time", "purchase_value", "device_id",
                  "source", "browser", "sex", "age", "ip_address", "class"]
sql("dq_null_counts", "select * from (" + "\nunion all\n".join(
    f"select '{c}' as column_name, cast(sum(case when {c} is null"
    + (f" or isnan({c})" if c in ("purchase_value", "ip_address") else "")
    + f" then 1 else 0 end) as bigint) as null_count from commerce_txn" for c in _COMMERCE_COLS)
    + ") where null_count > 0", "commerce_txn")


@query("dq_validate_commerce")
def dq_validate_commerce(spark, d):
    t = X.commerce_txn(spark, d)
    t = t.withColumn("time_since_signup_hours", S.hours_between("signup_time", "purchase_time"))
    return Q.validate(t, Q.commerce_rules(t)).select("txn_id", "is_valid", "reject_reason")


sql("dq_validate_commerce", """
select txn_id, cast(r = '' as int) as is_valid, nullif(r, '') as reject_reason from (
  select txn_id, concat_ws('; ',
    case when purchase_value is null then 'purchase_value missing' end,
    case when purchase_value <= 0 then 'purchase_value must be > 0' end,
    case when age is null then 'age missing' end,
    case when age < 18 or age > 120 then 'age must be in [18, 120]' end,
    case when epoch_us(purchase_time) - epoch_us(signup_time) < 0
         then 'time_since_signup_hours must be >= 0' end) as r
  from commerce_txn)""", "commerce_txn")


@query("dq_validate_card")
def dq_validate_card(spark, d):
    t = X.card_txn(spark, d)
    t = Q.card_defaults(t, V_COLUMNS)
    out = Q.validate(t, Q.card_rules(t))
    return r6(out.select("txn_id", "Amount", "V1", "V7", "V28", "is_valid", "reject_reason"))


sql("dq_validate_card", """
select txn_id, round("Amount", 6) as "Amount", round(coalesce(V1, 0.0), 6) as V1, cast(0.0 as double) as V7,
       cast(0.0 as double) as V28,
       cast(r = '' as int) as is_valid, nullif(r, '') as reject_reason from (
  select *, concat_ws('; ', case when "Time" is null then 'Time missing' end,
                       case when "Amount" is null then 'Amount missing' end,
                       case when "Amount" < 0 then 'Amount must be >= 0' end) as r
  from card_txn)""", "card_txn")


@query("filter_class")
def filter_class(spark, d):
    return r6(X.card_txn(spark, d).where(F.col("class") == 1).select("txn_id", "Amount"))


sql("filter_class", 'select txn_id, round("Amount", 6) as "Amount" from card_txn where class = 1', "card_txn")


@query("filter_country_known")
def filter_country_known(spark, d):
    return commerce_geo(spark, d).where(F.col("ip_country").isNotNull()).select("txn_id", "ip_country")


sql("filter_country_known", "select txn_id, ip_country from commerce_geo where ip_country is not null",
    "commerce_geo")


@query("project_drop")
def project_drop(spark, d):
    return r6(Q.drop_present(X.commerce_txn(spark, d), list(COMMERCE_DROP_COLUMNS)))


sql("project_drop", """
select txn_id, round(purchase_value, 6) as purchase_value, source, browser, sex, age, class
from commerce_txn""", "commerce_txn")


@query("project_numeric")
def project_numeric(spark, d):
    return r6(Q.keep_numeric(X.commerce_txn(spark, d)))


sql("project_numeric", """
select txn_id, user_id, round(purchase_value, 6) as purchase_value, age, round(ip_address, 6) as ip_address,
       class from commerce_txn""", "commerce_txn")


@query("project_align")
def project_align(spark, d):
    """Align to a model feature list: missing -> 0, extra dropped, order enforced."""
    feats = ["V3", "V1", "V9", "Amount", "V2", "hour"]
    return r6(Q.align(X.card_txn(spark, d), feats, keep=["txn_id"]))


sql("project_align", """
select txn_id, round(V3, 6) as V3, round(V1, 6) as V1, cast(0.0 as double) as V9,
       round("Amount", 6) as "Amount", round(V2, 6) as V2, cast(0.0 as double) as hour from card_txn""", "card_txn")
