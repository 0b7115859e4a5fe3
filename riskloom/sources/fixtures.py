"""Logical tables derived from the driver's Parquet test tables.

The modelled application reads three CSV files (purchases, IP ranges, card
transactions).  The test harness ships TPC-H-like tables instead, so each
logical table is a deterministic projection of one of them (see FIXTURES.md
part B).  These are plain DataFrame plans: column pruning and predicate
pushdown reach the Parquet scan, and every derived table grows with its
source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod_case(expr: Column, values) -> Column:
    out = None
    for i, v in enumerate(values):
        cond = expr == i
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def commerce_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases: one row per event; signup = the user's first event.

    ``signup_time`` is a per-user minimum attached back to rows.  It is an
    aggregate + join (map-side partial min, so a hot user costs nothing extra)
    rather than a window, which would funnel a hot user into one task.
    """
    ev = table(spark, sf_dir, "events")
    first_seen = ev.groupBy("user_id").agg(F.min("ts").alias("signup_time"))
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    return (
        ev.join(first_seen, "user_id", "left")
        .select(
            eid.alias("txn_id"),
            F.col("user_id"),
            F.col("signup_time"),
            F.col("ts").alias("purchase_time"),
            F.col("value").alias("purchase_value"),
            F.when(eid % 23 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("dev_"), k)).alias("device_id"),
            _mod_case(eid % 3, ["Ads", "SEO", "Direct"]).alias("source"),
            _mod_case(eid % 5, ["Chrome", "Firefox", "Safari", "IE"]).alias("browser"),
            F.when(F.col("user_id") % 2 == 0, "M").otherwise("F").alias("sex"),
            (eid % 105).cast("int").alias("age"),
            F.when(eid % 17 == 0, F.lit(None).cast("double"))
             .otherwise(((eid * F.lit(2654435761)) % F.lit(4294967296)).cast("double") + 0.5)
             .alias("ip_address"),
            (F.col("event_type") == "error").cast("int").alias("class_raw"),
        )
        .withColumn("class", F.coalesce(F.col("class_raw"), F.lit(0)))
        .drop("class_raw")
    )


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country ranges with gaps and overlaps, from nation and region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    nk = F.col("n_nationkey").cast("bigint")
    rk = F.col("r_regionkey").cast("bigint")
    a = nation.select(
        (nk * 171798691).alias("lower_bound_ip_address"),
        (nk * 171798691 + 120000000).alias("upper_bound_ip_address"),
        F.col("n_name").alias("country"))
    b = region.select(
        (rk * 858993459 + 50000000).alias("lower_bound_ip_address"),
        (rk * 858993459 + 60000000).alias("upper_bound_ip_address"),
        F.concat(F.lit("X_"), F.col("r_name")).alias("country"))
    return a.unionByName(b)


def _line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def card_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions: Time, Amount, V1..V6 and label from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        _line_key().alias("txn_id"),
        ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 172800).cast("double").alias("Time"),
        (F.col("l_extendedprice") / 100.0).alias("Amount"),
        F.col("l_quantity").alias("V1"),
        F.col("l_discount").alias("V2"),
        F.col("l_tax").alias("V3"),
        (F.col("l_partkey") % 97).cast("double").alias("V4"),
        (F.col("l_suppkey") % 13).cast("double").alias("V5"),
        F.col("l_linenumber").cast("double").alias("V6"),
        (F.col("l_returnflag") == "R").cast("int").alias("class"),
    )


def scores(spark: SparkSession, sf_dir: str, multiplier: int = 31) -> DataFrame:
    """Deterministic scored table with heavy ties and real separation."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.col("l_returnflag") == "R"
    raw = (F.col("l_orderkey") * multiplier + F.col("l_linenumber") * 17) % 700
    return li.select(
        _line_key().alias("txn_id"),
        pos.cast("int").alias("label"),
        ((raw + F.when(pos, 300).otherwise(0)).cast("double") / 1000.0).alias("fraud_probability"),
    )
