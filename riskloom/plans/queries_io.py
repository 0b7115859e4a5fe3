"""Registered queries: sources and sinks.

The driver's tables are Parquet; each source query first writes the derived
logical table in the format the modelled application reads (CSV / JSON)
into the shared scratch folder, then reads it back with the explicit schema,
so the reader path itself is exercised on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators import models as MD
from riskloom.operators import quality as Q
from riskloom.plans import features as FT
from riskloom.plans.catalog import query, r6, r6_scan
from riskloom.plans.oracle import SQL, sql
from riskloom.session import scratch_path
from riskloom.sources import fixtures as X
from riskloom.sources import io as IO


def _csv(df, spark, name):
    path = scratch_path(spark, name)
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path


@query("scan_commerce")
def scan_commerce(spark, d):
    path = _csv(X.commerce_txn(spark, d), spark, "commerce-csv")
    return r6_scan(IO.load_commerce(spark, path))


sql("scan_commerce", "select * replace (round(purchase_value, 6) as purchase_value, "
    "round(ip_address, 6) as ip_address) from commerce_txn", "commerce_txn")


@query("scan_card")
def scan_card(spark, d):
    card = X.card_txn(spark, d).withColumnRenamed("class", "Class")
    path = _csv(card, spark, "card-csv")
    return r6_scan(IO.load_card(spark, path))


sql("scan_card", """select txn_id, round("Time", 6) as "Time", round("Amount", 6) as "Amount",
  round(V1, 6) as V1, round(V2, 6) as V2, round(V3, 6) as V3, round(V4, 6) as V4, round(V5, 6) as V5,
  round(V6, 6) as V6, class from card_txn""", "card_txn")


@query("scan_ip_ranges")
def scan_ip_ranges(spark, d):
    """Ranges read from CSV (bounds as floats), unioned with the empty table a
    missing file yields (no rows, no error)."""
    r = X.ip_ranges(spark, d).select(
        (F.col("lower_bound_ip_address").cast("double") + 0.5).alias("lower_bound_ip_address"),
        F.col("upper_bound_ip_address").cast("double").alias("upper_bound_ip_address"), "country")
    path = _csv(r, spark, "ip-ranges-csv")
    missing = IO.load_ip_ranges(spark, scratch_path(spark, "no-such-file"))
    return IO.load_ip_ranges(spark, path).unionByName(missing)


sql("scan_ip_ranges", "select * from ip_ranges", "ip_ranges")


@query("sink_processed")
def sink_processed(spark, d):
    """Processed card features written (Parquet) and read back unchanged."""
    root = scratch_path(spark, "processed")
    IO.save_processed(FT.prepare_features(X.card_txn(spark, d), "creditcard"), "creditcard", root)
    return r6_scan(IO.load_processed(spark, "creditcard", root))


@query("scan_processed")
def scan_processed(spark, d):
    """Processed purchase features written as CSV (index-free) and re-read with a schema."""
    root = scratch_path(spark, "processed-csv")
    feats = FT.prepare_features(X.card_txn(spark, d), "creditcard")
    IO.save_processed(feats, "creditcard", root, fmt="csv")
    back = IO.load_processed(spark, "creditcard", root, schema=feats.schema, fmt="csv")
    return r6_scan(back)


@query("scan_batch_csv")
def scan_batch_csv(spark, d):
    """Batch CSV with malformed lines (age 'n/a' on every 97th id): PERMISSIVE
    read keeps them, flagged, with the bad field NULL."""
    t = X.commerce_txn(spark, d)
    age = F.when(F.col("txn_id") % 97 == 0, F.lit("n/a")).otherwise(F.col("age").cast("string"))
    lines = t.select(F.concat_ws(",", F.col("txn_id").cast("string"), F.col("purchase_value").cast("string"),
                                 age).alias("value"))
    path = scratch_path(spark, "batch-csv")
    lines.write.mode("overwrite").text(path)
    from riskloom.sources.io import REQUEST_SCHEMA, subset
    df = IO.read_csv(spark, path, subset(REQUEST_SCHEMA, ["txn_id", "purchase_value", "age"]),
                     header=False, corrupt=True)
    return r6(df.select("txn_id", "purchase_value", "age",
                        F.col(IO.CORRUPT).isNotNull().cast("int").alias("is_corrupt")))


sql("scan_batch_csv", """
select txn_id, round(purchase_value, 6) as purchase_value, case when txn_id % 97 = 0 then null else age end as age,
       cast(txn_id % 97 = 0 as int) as is_corrupt from commerce_txn""", "commerce_txn")


@query("scan_batch_json")
def scan_batch_json(spark, d):
    """Request rows as JSON lines, read with the request schema and validated."""
    t = X.commerce_txn(spark, d)
    req = t.select("txn_id", "user_id", "purchase_value", "age",
                   S.hour_of_day("purchase_time").alias("hour_of_day"),
                   S.day_of_week("purchase_time").alias("day_of_week"),
                   S.hours_between("signup_time", "purchase_time").alias("time_since_signup_hours"))
    path = scratch_path(spark, "batch-json")
    req.write.mode("overwrite").json(path)
    df = IO.read_json(spark, path, IO.REQUEST_SCHEMA)
    return Q.validate(df, Q.commerce_rules(df)).select("txn_id", "is_valid", "reject_reason")


sql("scan_batch_json", """
select txn_id, cast(r = '' as int) as is_valid, nullif(r, '') as reject_reason from (
  select txn_id, concat_ws('; ',
    case when purchase_value is null then 'purchase_value missing' end,
    case when purchase_value <= 0 then 'purchase_value must be > 0' end,
    case when age is null then 'age missing' end,
    case when age < 18 or age > 120 then 'age must be in [18, 120]' end,
    case when hour(purchase_time) < 0 or hour(purchase_time) >= 24 then 'hour_of_day must be in [0, 24)' end,
    case when isodow(purchase_time) - 1 < 0 or isodow(purchase_time) - 1 >= 7
         then 'day_of_week must be in [0, 7)' end,
    case when epoch_us(purchase_time) - epoch_us(signup_time) < 0
         then 'time_since_signup_hours must be >= 0' end) as r
  from commerce_txn)""", "commerce_txn")


@query("sink_scores")
def sink_scores(spark, d):
    """Scored rows written partitioned by risk band, read back."""
    scored = MD.score_details(X.scores(spark, d), 0.5, include_details=True)
    path = scratch_path(spark, "scores")
    IO.write_scores(scored, path)
    return r6_scan(spark.read.parquet(path))


@query("sink_metrics")
def sink_metrics(spark, d):
    """Metrics table (one row per model) to JSON lines and back."""
    from riskloom.plans.queries_metrics import eval_model_table
    path = scratch_path(spark, "metrics")
    IO.write_metrics(eval_model_table(spark, d), path)
    back = spark.read.schema(
        "model string, accuracy double, precision double, recall double, f1_score double, "
        "roc_auc double, average_precision double, is_best int").json(path)
    return r6(back)


def _copy_sql():
    SQL["sink_processed"] = SQL["prepare_features"]
    SQL["scan_processed"] = SQL["prepare_features"]
    SQL["sink_scores"] = SQL["score_details"]
    SQL["sink_metrics"] = SQL["eval_model_table"]


_copy_sql()
