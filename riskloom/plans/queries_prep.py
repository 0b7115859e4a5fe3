"""Registered queries: split, imputation, scaling, class weights, oversampling
and the feature preparation entry point."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import balance as B
from riskloom.config import DEFAULTS
from riskloom.operators import prep as P
from riskloom.operators.stages import ColumnScaler, MedianImputer
from riskloom.plans import features as FT
from riskloom.plans import pipeline as PL
from riskloom.plans.catalog import query, r6
from riskloom.plans.oracle import sql
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import fixtures as X

CARD_FEATURES = ["Amount", "V1", "V2", "V3", "V4", "V5", "V6"]
COMMERCE_NUMERIC = ["purchase_value", "age", "ip_address"]


def _split_sql(view):
    return f"""select *, cast(row_number() over (partition by class
                 order by md5(cast(txn_id as varchar) || ':42'), txn_id)
               <= round(0.2 * count(*) over (partition by class)) as int) as is_test from {view}"""


@query("split_stratified")
def split_stratified(spark, d):
    return P.stratified_split(X.commerce_txn(spark, d)).select("txn_id", "class", "is_test")


sql("split_stratified", "select txn_id, class, is_test from split", "commerce_txn",
    extra={"split": _split_sql("commerce_txn")})


@query("split_stratified_card")
def split_stratified_card(spark, d):
    """String keys, 60k rows at sf0.01: the cut-bucket path on both classes."""
    return P.stratified_split(X.card_txn(spark, d)).select("txn_id", "class", "is_test")


sql("split_stratified_card", "select txn_id, class, is_test from split", "card_txn",
    extra={"split": _split_sql("card_txn")})


@query("impute_median")
def impute_median(spark, d):
    """Medians fitted on the training split, applied to every row."""
    t = cut_lineage(P.stratified_split(X.commerce_txn(spark, d)))  # read by every refinement pass
    st = P.fit_medians(t.where(F.col("is_test") == 0), COMMERCE_NUMERIC)
    return r6(P.apply_medians(t, st).select("txn_id", "is_test", *COMMERCE_NUMERIC))


sql("impute_median", """
select txn_id, is_test, round(coalesce(purchase_value, m.mp), 6) as purchase_value,
       round(coalesce(age, m.ma), 6) as age, round(coalesce(ip_address, m.mi), 6) as ip_address
from split, (select median(purchase_value) as mp, median(age) as ma, median(ip_address) as mi
             from split where is_test = 0) m""", "commerce_txn", extra={"split": _split_sql("commerce_txn")})


def _card_split(spark, d):
    """The split is read by the fit passes and the transform: materialised once."""
    return cut_lineage(P.stratified_split(X.card_txn(spark, d)))


@query("scale_standard")
def scale_standard(spark, d):
    t = _card_split(spark, d)
    st = P.fit_scaler(t.where(F.col("is_test") == 0), CARD_FEATURES)
    return r6(P.apply_scaler(t, st).select("txn_id", "is_test", *CARD_FEATURES))


def _z(c):
    return (f'round((cast("{c}" as double) - m."m_{c}") / case when coalesce(m."s_{c}", 0) = 0 then 1 '
            f'else m."s_{c}" end, 6) as "{c}"')


_MOMENTS = ", ".join(f'avg("{c}") as "m_{c}", stddev_pop("{c}") as "s_{c}"' for c in CARD_FEATURES)
sql("scale_standard", f"""
select txn_id, is_test, {', '.join(_z(c) for c in CARD_FEATURES)}
from split, (select {_MOMENTS} from split where is_test = 0) m""", "card_txn",
    extra={"split": _split_sql("card_txn")})


@query("balance_class_weight")
def balance_class_weight(spark, d):
    return r6(P.class_weights(X.card_txn(spark, d)))


sql("balance_class_weight", """
select class, round(cast(sum(n) over () as double) / (count(*) over () * n), 6) as weight
from (select class, count(*) as n from card_txn group by class)""", "card_txn")


@query("fit_scaler_job")
def fit_scaler_job(spark, d):
    """Split -> fit impute + scale on train -> persist the state table."""
    t = _card_split(spark, d)
    train = t.where(F.col("is_test") == 0)
    pre = FT.Preprocessor(use_smote=False).fit(train, CARD_FEATURES)
    state = P.state_table(spark, pre.impute, pre.scale)
    path = scratch_path(spark, "scaler-state")
    state.write.mode("overwrite").parquet(path)
    saved = spark.read.parquet(path)
    # moments are float sums; a tiny nudge keeps half-way values on one side in both engines
    nudge = {c: F.round(F.col(c) + F.signum(c) * F.lit(1e-11), 6).alias(c) for c in ("mean", "std")}
    return r6(saved.select(*[nudge.get(c, F.col(c)) for c in saved.columns]), exact=("mean", "std"))


sql("fit_scaler_job", "select * from (" + "\nunion all\n".join(
    f"""select {i} as position, '{c}' as column_name, round(median("{c}"), 6) as median,
        round(avg("{c}") + sign(avg("{c}")) * 1e-11, 6) as mean,
        round(stddev_pop("{c}") + sign(stddev_pop("{c}")) * 1e-11, 6) as std from split where is_test = 0"""
    for i, c in enumerate(CARD_FEATURES)) + ")", "card_txn", extra={"split": _split_sql("card_txn")})


_CARD_Z = {c: f'((cast("{c}" as double) - avg("{c}") over ()) / case when coalesce(stddev_pop("{c}") over (), 0) = 0 '
              f'then 1 else stddev_pop("{c}") over () end)' for c in ("Time", "Amount")}


@query("prepare_features")
def prepare_features(spark, d):
    """Card features (fit on the batch), drop Time/Amount, numeric columns."""
    return r6(FT.prepare_features(X.card_txn(spark, d), "creditcard"))


sql("prepare_features", f"""
select txn_id, round(V1, 6) as V1, round(V2, 6) as V2, round(V3, 6) as V3, round(V4, 6) as V4,
  round(V5, 6) as V5, round(V6, 6) as V6, class,
  round({_CARD_Z['Time']}, 6) as scaled_time, round({_CARD_Z['Amount']}, 6) as scaled_amount,
  round((("Time" / 3600.0) % 24 + 24) % 24, 6) as hour, cast(trunc("Time" / 86400.0) as int) as day,
  round(ln(1 + "Amount"), 6) as log_amount,
  case when "Amount" <= 10 then 0 when "Amount" <= 50 then 1 when "Amount" <= 100 then 2
       when "Amount" <= 500 then 3 when "Amount" > 500 then 4 else -1 end as amount_category,
  {', '.join(f'round(V{i} * {_CARD_Z["Amount"]}, 6) as V{i}_amount_interaction' for i in range(1, 6))}
from card_txn""", "card_txn")


@query("prepare_features_commerce")
def prepare_features_commerce(spark, d):
    """Full purchase feature build (as-of join, windows, aggregates, encodings)."""
    out = FT.prepare_features(X.commerce_txn(spark, d), "fraud", ranges=X.ip_ranges(spark, d))
    return r6(out, exact=("time_since_signup_hours", "purchase_velocity_minutes"))


_HRS = "(cast(epoch_us(purchase_time) - epoch_us(signup_time) as double) / cast(3.6e9 as double))"
sql("prepare_features_commerce", f"""
select g.txn_id, round(g.purchase_value, 6) as purchase_value, g.age, g.class, g.ip_as_int,
  case when h.ip_country is not null then 1 else 0 end as is_high_risk_country,
  cast(hour(purchase_time) as int) as hour_of_day, cast(isodow(purchase_time) - 1 as int) as day_of_week,
  cast(isodow(purchase_time) in (6, 7) as int) as is_weekend, cast(day(purchase_time) as int) as day_of_month,
  cast(month(purchase_time) as int) as month, {_HRS} as time_since_signup_hours,
  {_HRS} * cast(60.0 as double) as purchase_velocity_minutes,
  coalesce(cast({_HRS} < 1.0 as int), 0) as quick_purchase,
  coalesce(cast({_HRS} < 0.0833 as int), 0) as instant_purchase,
  case when device_id is null then null else count(*) over (partition by device_id) end as device_frequency,
  case when ip_address is null then null else count(*) over (partition by ip_address) end as ip_frequency,
  round(ln(1 + purchase_value), 6) as log_purchase_value,
  coalesce(cast(purchase_value % 1 = 0 as int), 0) as purchase_value_rounded,
  case when age > 0 and age <= 18 then 0 when age > 18 and age <= 25 then 1 when age > 25 and age <= 35 then 2
       when age > 35 and age <= 45 then 3 when age > 45 and age <= 55 then 4 when age > 55 and age <= 65 then 5
       when age > 65 and age <= 100 then 6 else -1 end as age_group,
  case when device_id is null then null else
    row_number() over (partition by device_id order by purchase_time, txn_id) end as device_usage_count,
  case when ip_address is null then null else
    row_number() over (partition by ip_address order by purchase_time, txn_id) end as ip_usage_count,
  case when device_id is null then null else
    count(user_id) over (partition by device_id order by purchase_time
                         range between interval '3599999999 microseconds' preceding and current row)
    - count(user_id) over (partition by device_id, purchase_time)
    + count(user_id) over (partition by device_id, purchase_time order by txn_id
                           rows between unbounded preceding and current row) end as device_freq_1h,
  u.users_per_device, v.users_per_ip,
  coalesce(cast(browser = 'Firefox' as int), 0) as browser_Firefox,
  coalesce(cast(browser = 'IE' as int), 0) as browser_IE,
  coalesce(cast(browser = 'Safari' as int), 0) as browser_Safari,
  coalesce(cast(source = 'Direct' as int), 0) as source_Direct,
  coalesce(cast(source = 'SEO' as int), 0) as source_SEO,
  coalesce(cast(sex = 'M' as int), 0) as sex_M
from commerce_geo g
left join (select ip_country from commerce_geo where ip_country is not null
           group by ip_country having avg(class) > 0.2 and count(class) > 10) h on g.ip_country = h.ip_country
left join (select device_id as u_dev, count(distinct user_id) as users_per_device from commerce_txn
           where device_id is not null group by device_id) u on g.device_id = u.u_dev
left join (select ip_address as v_ip, count(distinct user_id) as users_per_ip from commerce_txn
           where ip_address is not null group by ip_address) v on g.ip_address = v.v_ip""",
    "commerce_geo")

# --------------------------------------------------------- oversampling --

_SMOTE_FEATURES = ["purchase_value", "age"]


def _commerce_train(spark, d):
    t = P.stratified_split(X.commerce_txn(spark, d))
    return t.where(F.col("is_test") == 0).select("txn_id", "class", *_SMOTE_FEATURES)


@query("balance_smote")
def balance_smote(spark, d):
    """Training rows plus synthetic minority rows (ratio 0.5, k = 5, seed 42)."""
    tr = _commerce_train(spark, d)
    pre = FT.Preprocessor(use_smote=False).fit(tr, _SMOTE_FEATURES)
    return B.smote(pre.transform(tr), _SMOTE_FEATURES, label="class", key="txn_id")


@query("union_synthetic")
def union_synthetic(spark, d):
    out = balance_smote(spark, d)
    return out.groupBy("class", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


sql("union_synthetic", """
select class, 0 as is_synthetic, count(*) as n from split where is_test = 0 group by class
union all
select 1, 1, cast(floor(0.5 * sum(case when class = 0 then 1 else 0 end)
                        - sum(case when class = 1 then 1 else 0 end)) as bigint)
from split where is_test = 0""", "commerce_txn", extra={"split": _split_sql("commerce_txn")})


@query("preprocess_pipeline")
def preprocess_pipeline(spark, d):
    """impute -> scale -> SMOTE on train; impute -> scale on test; one table."""
    from riskloom.operators.balance import smote
    t = cut_lineage(P.stratified_split(X.commerce_txn(spark, d)).select("txn_id", "class", "is_test", *COMMERCE_NUMERIC))
    train, test = t.where(F.col("is_test") == 0), t.where(F.col("is_test") == 1)
    pre = Pipeline(stages=[MedianImputer(inputCols=COMMERCE_NUMERIC), ColumnScaler(inputCols=COMMERCE_NUMERIC)]).fit(train)
    tr = smote(pre.transform(train), COMMERCE_NUMERIC, label="class", key="txn_id",
               ratio=DEFAULTS.oversample_ratio, k=DEFAULTS.smote_k, seed=DEFAULTS.seed)
    return tr.unionByName(pre.transform(test).withColumn("is_synthetic", F.lit(0)))


@query("preprocess_pipeline_transform")
def preprocess_pipeline_transform(spark, d):
    """One ``pyspark.ml`` Pipeline (features -> medians -> scaling), fitted on
    the raw training rows, saved, loaded, and applied to all raw rows."""
    t = _card_split(spark, d)
    model = PL.preparation("creditcard", keep=["is_test"]).fit(t.where(F.col("is_test") == 0))
    path = scratch_path(spark, "preparation")
    model.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(t)
    return r6(out.withColumn("class", F.col("class").cast("int")).withColumn("is_test", F.col("is_test").cast("int")))


_FEATURES = {f"V{i}": f"V{i}" for i in range(1, 7)} | {
    "scaled_time": '("Time" - tm) / ts', "scaled_amount": '("Amount" - am) / "as"',
    "hour": '(("Time" / 3600.0) % 24 + 24) % 24', "day": 'trunc("Time" / 86400.0)', "log_amount": 'ln(1 + "Amount")',
    "amount_category": 'case when "Amount" <= 10 then 0 when "Amount" <= 50 then 1 when "Amount" <= 100 then 2 '
                       'when "Amount" <= 500 then 3 when "Amount" > 500 then 4 else -1 end',
} | {f"V{i}_amount_interaction": f'V{i} * (("Amount" - am) / "as")' for i in range(1, 6)}
sql("preprocess_pipeline_transform", f"""
select txn_id, class, is_test, {', '.join(
    f'round(({c} - avg({c}) filter (is_test = 0) over ()) / coalesce(nullif(stddev_pop({c}) filter (is_test = 0) over (), 0), 1), 6) as {c}' for c in _FEATURES)}
from (select txn_id, class, is_test, {', '.join(f'cast({e} as double) as {c}' for c, e in _FEATURES.items())}
      from split, (select avg("Time") as tm, stddev_pop("Time") as ts, avg("Amount") as am, stddev_pop("Amount") as "as"
                   from split where is_test = 0) m)""", "card_txn", extra={"split": _split_sql("card_txn")})
