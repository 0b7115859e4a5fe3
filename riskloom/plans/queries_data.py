"""Registered queries over the purchase/card tables: scans, joins, aggregates,
windows, top-k, data quality, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators.asof import broadcast_range_join, disjoint_ranges
from riskloom.plans import commerce as C
from riskloom.plans.catalog import commerce_geo, query, r6
from riskloom.plans.oracle import sql
from riskloom.sources import fixtures as X

# ================================================================ joins =====


@query("join_ip_country_asof")
def join_ip_country_asof(spark, d):
    return commerce_geo(spark, d).select("txn_id", "ip_as_int", "ip_country")


sql("join_ip_country_asof", "select txn_id, ip_as_int, ip_country from commerce_geo", "commerce_geo")


@query("join_ip_country_broadcast")
def join_ip_country_broadcast(spark, d):
    t = C.with_ip_int(X.commerce_txn(spark, d))
    r = X.ip_ranges(spark, d).withColumnRenamed("country", "ip_country")
    out = broadcast_range_join(t, "ip_as_int", r, C.IP_LOWER, C.IP_UPPER, ["ip_country"])
    return out.select("txn_id", "ip_as_int", "ip_country")


sql("join_ip_country_broadcast", "select txn_id, ip_as_int, ip_country from commerce_geo", "commerce_geo")


@query("win_disjoint_ranges")
def win_disjoint_ranges(spark, d):
    r = X.ip_ranges(spark, d)
    return disjoint_ranges(r, C.IP_LOWER, C.IP_UPPER, ["country"])


sql("win_disjoint_ranges", """
select lo, hi, country from (
  select lower_bound_ip_address as lo,
         case when nxt is null then upper_bound_ip_address
              else least(upper_bound_ip_address, nxt - 1) end as hi, country
  from (select *, lead(lower_bound_ip_address) over (
          order by lower_bound_ip_address, upper_bound_ip_address, country) as nxt
        from ip_ranges))
where lo <= hi""", "ip_ranges")

# ========================================================== aggregates =====


@query("agg_country_fraud")
def agg_country_fraud(spark, d):
    return r6(A.country_fraud(commerce_geo(spark, d)))


_COUNTRY_FRAUD = """
select ip_country, count(class) as total_transactions, cast(sum(class) as bigint) as fraud_count,
       round(cast(sum(class) as double) / count(class), 6) as fraud_rate
from commerce_geo where ip_country is not null group by ip_country"""
sql("agg_country_fraud", _COUNTRY_FRAUD, "commerce_geo")


@query("topk_country_rate")
def topk_country_rate(spark, d):
    cf = A.country_fraud(commerce_geo(spark, d))
    return r6(cf.orderBy(F.desc("fraud_rate"), F.asc("ip_country")).limit(10))


sql("topk_country_rate", "select * from country_fraud order by fraud_rate desc, ip_country limit 10",
    "commerce_geo", extra={"country_fraud": _COUNTRY_FRAUD})


@query("agg_country_stats_fit")
def agg_country_stats_fit(spark, d):
    return r6(A.country_stats_fit(commerce_geo(spark, d)))


sql("agg_country_stats_fit", """
select ip_country, count(class) as n, round(avg(class), 6) as fraud_rate
from commerce_geo where ip_country is not null group by ip_country""", "commerce_geo")


@query("agg_high_risk_set")
def agg_high_risk_set(spark, d):
    return A.high_risk_set(A.country_stats_fit(commerce_geo(spark, d)))


_HIGH_RISK = """
select ip_country from commerce_geo where ip_country is not null
group by ip_country having avg(class) > 0.2 and count(class) > 10"""
sql("agg_high_risk_set", _HIGH_RISK, "commerce_geo")


@query("agg_high_risk_set_simple")
def agg_high_risk_set_simple(spark, d):
    cf = A.country_fraud(commerce_geo(spark, d))
    return r6(cf.where(F.col("fraud_rate") > 0.2).select("ip_country", "fraud_rate"))


sql("agg_high_risk_set_simple",
    "select ip_country, round(fraud_rate, 6) as fraud_rate from country_fraud where fraud_rate > 0.2",
    "commerce_geo", extra={"country_fraud": _COUNTRY_FRAUD.replace(
        "round(cast(sum(class) as double) / count(class), 6)",
        "cast(sum(class) as double) / count(class)")})


def _ip_key(df):
    """Stand-in address for IP grouping on the fixture (IPs are nearly unique)."""
    return df.withColumn("ip_key", F.shiftright(F.col("ip_as_int"), 24))


@query("agg_device_frequency")
def agg_device_frequency(spark, d):
    t = X.commerce_txn(spark, d)
    return A.key_frequency(t, "device_id", "device_frequency").select(
        "txn_id", "device_id", "device_frequency")


sql("agg_device_frequency", """
select txn_id, device_id,
       case when device_id is null then null else count(*) over (partition by device_id) end as device_frequency
from commerce_txn""", "commerce_txn")


@query("agg_ip_frequency")
def agg_ip_frequency(spark, d):
    t = _ip_key(C.with_ip_int(X.commerce_txn(spark, d)))
    return A.key_frequency(t, "ip_key", "ip_frequency").select("txn_id", "ip_key", "ip_frequency")


_IPK = "(select *, coalesce(cast(floor(ip_address) as bigint), 0) >> 24 as ip_key from commerce_txn)"
sql("agg_ip_frequency", f"""
select txn_id, ip_key, count(*) over (partition by ip_key) as ip_frequency from {_IPK}""", "commerce_txn")


@query("agg_users_per_device")
def agg_users_per_device(spark, d):
    t = X.commerce_txn(spark, d)
    return A.distinct_users(t, "device_id", "user_id", "users_per_device").select(
        "txn_id", "device_id", "users_per_device")


sql("agg_users_per_device", """
select t.txn_id, t.device_id, u.users_per_device from commerce_txn t
left join (select device_id, count(distinct user_id) as users_per_device from commerce_txn
           where device_id is not null group by device_id) u on t.device_id = u.device_id""", "commerce_txn")


@query("agg_users_per_ip")
def agg_users_per_ip(spark, d):
    t = _ip_key(C.with_ip_int(X.commerce_txn(spark, d)))
    return A.distinct_users(t, "ip_key", "user_id", "users_per_ip").select(
        "txn_id", "ip_key", "users_per_ip")


sql("agg_users_per_ip", f"""
select t.txn_id, t.ip_key, u.users_per_ip from {_IPK} t
left join (select ip_key, count(distinct user_id) as users_per_ip from {_IPK} group by ip_key) u
on t.ip_key = u.ip_key""", "commerce_txn")


@query("agg_summary")
def agg_summary(spark, d):
    return r6(A.dataset_summary(X.commerce_txn(spark, d)))


sql("agg_summary", """
select count(*) as n_rows, cast(sum(case when class = 1 then 1 else 0 end) as bigint) as n_fraud,
       round(sum(case when class = 1 then 1 else 0 end) * 100.0 / count(*), 6) as fraud_rate_pct,
       cast(count(*) - sum(case when class = 1 then 1 else 0 end) as bigint) as n_normal,
       cast(12 as int) as n_columns
from commerce_txn""", "commerce_txn")


def _flagged(spark, d):
    g = commerce_geo(spark, d)
    hr = A.high_risk_set(A.country_stats_fit(g))
    return A.flag_in_set(g, "ip_country", hr, "ip_country", "is_high_risk_country")


_FLAGGED = f"""
select g.*, case when h.ip_country is not null then 1 else 0 end as is_high_risk_country
from commerce_geo g left join ({_HIGH_RISK}) h on g.ip_country = h.ip_country"""


@query("join_state_lookup")
def join_state_lookup(spark, d):
    return _flagged(spark, d).select("txn_id", "ip_country", "is_high_risk_country")


sql("join_state_lookup", "select txn_id, ip_country, is_high_risk_country from flagged",
    "commerce_geo", extra={"flagged": _FLAGGED})


@query("agg_count_distinct_country")
def agg_count_distinct_country(spark, d):
    return A.count_distinct_countries(X.ip_ranges(spark, d), _flagged(spark, d))


sql("agg_count_distinct_country", """
select 'n_range_countries' as metric, cast(count(distinct country) as bigint) as value from ip_ranges
union all select 'n_data_countries', cast(count(distinct ip_country) as bigint) from flagged
union all select 'n_mapped', cast(count(ip_country) as bigint) from flagged
union all select 'n_flagged', cast(sum(is_high_risk_country) as bigint) from flagged""",
    "commerce_geo", extra={"flagged": _FLAGGED})

CARD_NUMERIC = ["Time", "Amount", "V1", "V2", "V3", "V4", "V5", "V6"]


@query("agg_describe")
def agg_describe(spark, d):
    return r6(A.describe(X.card_txn(spark, d), CARD_NUMERIC), exact=("mean",))


sql("agg_describe", "\nunion all\n".join(f"""
select '{c}' as column_name, count("{c}") as count, cast(sum(cast("{c}" as decimal(38,6))) as double) / count("{c}") as mean,
  round(stddev_samp("{c}"), 6) as std, round(min("{c}"), 6) as min,
  round(quantile_cont("{c}", 0.25), 6) as q25, round(quantile_cont("{c}", 0.5), 6) as q50,
  round(quantile_cont("{c}", 0.75), 6) as q75, round(max("{c}"), 6) as max from card_txn"""
                                       for c in CARD_NUMERIC), "card_txn")


@query("agg_corr_label")
def agg_corr_label(spark, d):
    return r6(A.corr_with_label(X.card_txn(spark, d), CARD_NUMERIC, "class", top=15))


sql("agg_corr_label", """
select feature, round(corr, 6) as corr, round(abs(corr), 6) as abs_corr,
       cast(row_number() over (order by abs(corr) desc, feature) as int) as rank
from (""" + "\nunion all\n".join(
    f"select '{c}' as feature, corr(\"{c}\", class) as corr from card_txn" for c in CARD_NUMERIC)
    + ") where corr is not null and not isnan(corr) qualify rank <= 15", "card_txn")


@query("agg_corr_matrix")
def agg_corr_matrix(spark, d):
    card = X.card_txn(spark, d)
    top = A.corr_with_label(card, CARD_NUMERIC, "class", top=10)
    # at most 10 feature names: a bounded metadata fetch
    names = [r["feature"] for r in top.orderBy("rank").select("feature").collect()]
    return r6(A.corr_matrix(card, names + ["class"]))


_CM = CARD_NUMERIC + ["class"]
sql("agg_corr_matrix", "\nunion all\n".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr(\"{a}\", \"{b}\"), 6) as corr from card_txn"
    for a in _CM for b in _CM), "card_txn")


@query("agg_box_stats")
def agg_box_stats(spark, d):
    return r6(A.box_stats(X.commerce_txn(spark, d), "purchase_value", "class"))


sql("agg_box_stats", """
select class, round(min(purchase_value), 6) as min, round(quantile_cont(purchase_value, 0.25), 6) as q1,
  round(quantile_cont(purchase_value, 0.5), 6) as median, round(quantile_cont(purchase_value, 0.75), 6) as q3,
  round(max(purchase_value), 6) as max
from commerce_txn group by class""", "commerce_txn")


@query("agg_histogram_amount")
def agg_histogram_amount(spark, d):
    return r6(A.histogram_by_group(X.card_txn(spark, d), "Amount", "class", 50))


sql("agg_histogram_amount", """
select g.class, b.bin, round(g.mn + b.bin * g.w, 6) as bin_lo, round(g.mn + (b.bin + 1) * g.w, 6) as bin_hi,
       cast(coalesce(c.n, 0) as bigint) as count
from (select class, min("Amount") as mn, (max("Amount") - min("Amount")) / 50.0 as w
      from card_txn group by class) g
cross join (select cast(range as int) as bin from range(50)) b
left join (select t.class, cast(case when g2.w = 0 then 0
                    else least(floor((t."Amount" - g2.mn) / g2.w), 49) end as int) as bin, count(*) as n
           from card_txn t join (select class, min("Amount") as mn,
                                  (max("Amount") - min("Amount")) / 50.0 as w from card_txn group by class) g2
           on t.class = g2.class group by 1, 2) c
  on c.class = g.class and c.bin = b.bin""", "card_txn")


@query("agg_histogram_score")
def agg_histogram_score(spark, d):
    return r6(A.histogram_fixed(X.scores(spark, d), "fraud_probability", 0.0, 1.0, 50))


sql("agg_histogram_score", """
select b.bin, round(b.bin * cast(0.02 as double), 6) as bin_lo,
       round((b.bin + 1) * cast(0.02 as double), 6) as bin_hi,
       cast(coalesce(c.n, 0) as bigint) as count
from (select cast(range as int) as bin from range(50)) b
left join (select cast(least(greatest(floor(fraud_probability / cast(0.02 as double)), 0), 49) as int) as bin,
                  count(*) as n from scores group by 1) c on b.bin = c.bin""", "scores")


@query("agg_fraud_over_time")
def agg_fraud_over_time(spark, d):
    return r6(A.amount_over_time(X.card_txn(spark, d)))


sql("agg_fraud_over_time", """
select cast(floor("Time" / 3600.0) as bigint) as hour, class, count(*) as n,
       round(sum("Amount"), 6) as total_amount, round(max("Amount"), 6) as max_amount
from card_txn group by 1, 2""", "card_txn")


# ======================================================== scored views =====

def _scored(spark, d, threshold=0.5):
    from riskloom.functions import scalar as S
    sc = X.scores(spark, d)
    return sc.select("*", S.is_fraud("fraud_probability", threshold).alias("is_fraud"),
                     S.risk_level("fraud_probability").alias("risk_level"))


_SCORED = """
select *, cast(fraud_probability >= 0.5 as int) as is_fraud,
  case when fraud_probability < 0.3 then 'low' when fraud_probability < 0.6 then 'medium'
       when fraud_probability < 0.8 then 'high' else 'critical' end as risk_level
from scores"""


@query("agg_batch_summary")
def agg_batch_summary(spark, d):
    return r6(A.batch_summary(_scored(spark, d)))


sql("agg_batch_summary", """
select count(*) as total_transactions, cast(coalesce(sum(is_fraud), 0) as bigint) as fraud_detected,
       round(case when count(*) > 0 then coalesce(sum(is_fraud), 0) * 100.0 / count(*) else 0.0 end, 6)
         as fraud_percentage
from scored""", "scores", extra={"scored": _SCORED})


@query("agg_risk_counts")
def agg_risk_counts(spark, d):
    return A.risk_counts(_scored(spark, d))


sql("agg_risk_counts", "select risk_level, count(*) as n from scored group by risk_level",
    "scores", extra={"scored": _SCORED})


@query("join_transform_back")
def join_transform_back(spark, d):
    t = X.commerce_txn(spark, d)
    out = A.attach_group_aggs(t, "device_id", {
        "device_txn_count": F.count(F.lit(1)),
        "device_total_value": F.sum("purchase_value")})
    return r6(out.select("txn_id", "device_id", "device_txn_count", "device_total_value"))


sql("join_transform_back", """
select txn_id, device_id,
  case when device_id is null then null else count(*) over (partition by device_id) end as device_txn_count,
  case when device_id is null then null else round(sum(purchase_value) over (partition by device_id), 6) end
    as device_total_value
from commerce_txn""", "commerce_txn")


@query("join_attach_label")
def join_attach_label(spark, d):
    from riskloom.functions import scalar as S
    t = X.commerce_txn(spark, d)
    feats = t.select("txn_id", S.hour_of_day("purchase_time").alias("hour_of_day"))
    labels = t.select("txn_id", "class")
    return feats.join(labels, "txn_id", "inner")


sql("join_attach_label", """
select f.txn_id, f.hour_of_day, l.class
from (select txn_id, cast(hour(purchase_time) as int) as hour_of_day from commerce_txn) f
join (select txn_id, class from commerce_txn) l on f.txn_id = l.txn_id""", "commerce_txn")


@query("join_attach_scores")
def join_attach_scores(spark, d):
    from riskloom.functions import scalar as S
    card = X.card_txn(spark, d).select("txn_id", "Amount")
    sc = X.scores(spark, d).select("txn_id", "fraud_probability")
    out = card.join(sc, "txn_id", "inner").withColumn("is_fraud", S.is_fraud("fraud_probability"))
    return r6(out)


sql("join_attach_scores", """
select c.txn_id, round(c."Amount", 6) as "Amount", round(s.fraud_probability, 6) as fraud_probability,
       cast(s.fraud_probability >= 0.5 as int) as is_fraud
from card_txn c join scores s on c.txn_id = s.txn_id""", "card_txn", "scores")

# ============================================================== windows =====


@query("win_device_usage_count")
def win_device_usage_count(spark, d):
    from riskloom.operators.velocity import usage_count
    t = X.commerce_txn(spark, d)
    return usage_count(t, "device_id", "purchase_time", "txn_id", "device_usage_count").select(
        "txn_id", "device_id", "device_usage_count")


sql("win_device_usage_count", """
select txn_id, device_id, case when device_id is null then null else
  row_number() over (partition by device_id order by purchase_time, txn_id) end as device_usage_count
from commerce_txn""", "commerce_txn")


@query("win_ip_usage_count")
def win_ip_usage_count(spark, d):
    from riskloom.operators.velocity import usage_count
    t = _ip_key(C.with_ip_int(X.commerce_txn(spark, d)))
    return usage_count(t, "ip_key", "purchase_time", "txn_id", "ip_usage_count").select(
        "txn_id", "ip_key", "ip_usage_count")


sql("win_ip_usage_count", f"""
select txn_id, ip_key, row_number() over (partition by ip_key order by purchase_time, txn_id) as ip_usage_count
from {_IPK}""", "commerce_txn")


@query("win_device_freq_1h")
def win_device_freq_1h(spark, d):
    from riskloom.operators.velocity import trailing_count
    t = X.commerce_txn(spark, d)
    return trailing_count(t, "device_id", "purchase_time", "txn_id", "user_id", "device_freq_1h").select(
        "txn_id", "device_id", "device_freq_1h")


_FREQ_1H = """
case when device_id is null then null else
  count(user_id) over (partition by device_id order by purchase_time
                       range between interval '3599999999 microseconds' preceding and current row)
  - count(user_id) over (partition by device_id, purchase_time)
  + count(user_id) over (partition by device_id, purchase_time order by txn_id
                         rows between unbounded preceding and current row) end"""
sql("win_device_freq_1h", f"select txn_id, device_id, {_FREQ_1H} as device_freq_1h from commerce_txn",
    "commerce_txn")



@query("win_velocity_hot_device")
def win_velocity_hot_device(spark, d):
    """Worst-case skew: every purchase on one device.  The range-partitioned
    plan splits the single key over all partitions; same semantics as
    ``win_device_usage_count`` + ``win_device_freq_1h``."""
    from riskloom.operators.velocity import key_velocity_ranged
    t = X.commerce_txn(spark, d).withColumn("device_id", F.lit("dev_hot"))
    return key_velocity_ranged(t, "device_id", "purchase_time", "txn_id", count_col="user_id",
                               usage_out="device_usage_count", freq_out="device_freq_1h").select(
        "txn_id", "device_id", "device_usage_count", "device_freq_1h")


sql("win_velocity_hot_device", """
select txn_id, device_id,
  row_number() over (partition by device_id order by purchase_time, txn_id) as device_usage_count,
  count(user_id) over (partition by device_id order by purchase_time
                       range between interval '3599999999 microseconds' preceding and current row)
  - count(user_id) over (partition by device_id, purchase_time)
  + count(user_id) over (partition by device_id, purchase_time order by txn_id
                         rows between unbounded preceding and current row) as device_freq_1h
from (select * replace ('dev_hot' as device_id) from commerce_txn)""", "commerce_txn")

# ======================================================= top-k / limits =====


@query("topk_country_count")
def topk_country_count(spark, d):
    g = commerce_geo(spark, d).where(F.col("class") == 1)
    cnt = g.where(F.col("ip_country").isNotNull()).groupBy("ip_country").agg(
        F.count(F.lit(1)).alias("fraud_count"))
    return cnt.orderBy(F.desc("fraud_count"), F.asc("ip_country")).limit(10)


sql("topk_country_count", """
select ip_country, count(*) as fraud_count from commerce_geo
where class = 1 and ip_country is not null group by ip_country
order by fraud_count desc, ip_country limit 10""", "commerce_geo")


@query("limit_preview")
def limit_preview(spark, d):
    return X.commerce_txn(spark, d).orderBy("txn_id").limit(20)


sql("limit_preview", "select * from commerce_txn order by txn_id limit 20", "commerce_txn")


@query("sample_fixed_n")
def sample_fixed_n(spark, d, n=100, seed=42):
    t = X.commerce_txn(spark, d)
    h = F.md5(F.concat(F.col("txn_id").cast("string"), F.lit(f":{seed}")))
    return t.orderBy(h, "txn_id").limit(n)


sql("sample_fixed_n", """
select * from commerce_txn order by md5(concat(cast(txn_id as varchar), ':42')), txn_id limit 100""",
    "commerce_txn")
