"""Running counts and 1h trailing counts, skew-safe buckets, NULL keys."""

import datetime as dt

from riskloom.operators.velocity import key_velocity


def _rows(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, "a", 7, t(0, 10)), (2, "a", 7, t(0, 10)), (3, "a", 8, t(1, 5)), (4, "a", 9, t(1, 10)),
            (5, None, 1, t(0, 0)), (6, None, 2, t(0, 1))]
    return spark.createDataFrame(rows, "txn_id long, device_id string, user_id long, ts timestamp_ntz")


def test_trailing_hour_ties_and_running_count(spark):
    out = key_velocity(_rows(spark), "device_id", "ts", "txn_id", count_col="user_id",
                       usage_out="usage", freq_out="freq_1h")
    got = {r["txn_id"]: (r["usage"], r["freq_1h"]) for r in out.collect()}
    assert got[1] == (1, 1) and got[2] == (2, 2) and got[3] == (3, 3) and got[4] == (4, 2)
    assert got[5] == (None, None) and got[6] == (None, None)


def test_bucket_width_does_not_change_result(spark):
    df = _rows(spark)
    a = key_velocity(df, "device_id", "ts", "txn_id", count_col="user_id", usage_out="u", freq_out="f")
    b = key_velocity(df, "device_id", "ts", "txn_id", count_col="user_id", usage_out="u", freq_out="f",
                     bucket_us=7 * 3_600_000_000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ranged_equals_buckets_and_survives_a_hot_key(spark):
    from pyspark.sql import functions as F

    from riskloom.operators.velocity import key_velocity_ranged
    from riskloom.sources import fixtures as X
    from tests.conftest import SF0001
    t = X.commerce_txn(spark, SF0001)
    for df in (t, t.withColumn("device_id", F.lit("hot"))):  # every row on one device
        a = key_velocity(df, "device_id", "purchase_time", "txn_id", count_col="user_id",
                         usage_out="u", freq_out="f")
        b = key_velocity_ranged(df, "device_id", "purchase_time", "txn_id", count_col="user_id",
                                usage_out="u", freq_out="f", partitions=7)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
