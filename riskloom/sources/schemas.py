"""Explicit schemas for every logical table (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

COMMERCE_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("signup_time", T.TimestampNTZType()),
    T.StructField("purchase_time", T.TimestampNTZType()),
    T.StructField("purchase_value", T.DoubleType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("browser", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("ip_address", T.DoubleType()),
    T.StructField("class", T.IntegerType()),
])

IP_RANGE_SCHEMA = T.StructType([
    T.StructField("lower_bound_ip_address", T.LongType()),
    T.StructField("upper_bound_ip_address", T.LongType()),
    T.StructField("country", T.StringType()),
])

V_COLUMNS = [f"V{i}" for i in range(1, 29)]

CARD_SCHEMA = T.StructType(
    [T.StructField("txn_id", T.StringType()),
     T.StructField("Time", T.DoubleType()),
     T.StructField("Amount", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in V_COLUMNS]
    + [T.StructField("class", T.IntegerType())]
)

SCORES_SCHEMA = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("fraud_probability", T.DoubleType()),
])


def subset(schema: T.StructType, names) -> T.StructType:
    keep = set(names)
    return T.StructType([f for f in schema.fields if f.name in keep])
