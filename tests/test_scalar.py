"""Edge cases of the scalar feature functions (FIXTURES.md part C)."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import scalar as S


def col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_age_group(spark):
    df = col(spark, [0.0, 18.0, 18.5, 25.0, 65.0, 100.0, 101.0, None], "double")
    got = [r[0] for r in df.select(S.age_group("x")).collect()]
    assert got == [-1, 0, 1, 1, 5, 6, -1, -1]


def test_amount_category(spark):
    df = col(spark, [10.0, 10.01, 50.0, 100.0, 500.0, 500.01, None], "double")
    got = [r[0] for r in df.select(S.amount_category("x")).collect()]
    assert got == [0, 1, 1, 2, 3, 4, -1]


def test_one_hot_drop_first_and_null(spark):
    df = col(spark, ["Chrome", "Safari", None, "IE"], "string").withColumnRenamed("x", "browser")
    out = df.select(*S.one_hot("browser", ["Chrome", "Safari", "IE"]))
    assert out.columns == ["browser_IE", "browser_Safari"]
    assert [tuple(r) for r in out.collect()] == [(0, 0), (0, 1), (0, 0), (1, 0)]


def test_ip_to_int(spark):
    df = col(spark, ["192.168.1.1", "invalid", "300.0.0.1", "1.2.3.4.5", None], "string")
    got = [r[0] for r in df.select(S.ip_to_int("x")).collect()]
    assert got == [3232235777, 0, 5033164801, 16909060, 0]


def test_quick_and_instant_purchase(spark):
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    gaps = [3600, 3599, 300, 299, -10]
    rows = [(base - dt.timedelta(seconds=g), base) for g in gaps]
    df = spark.createDataFrame(rows, "s timestamp_ntz, p timestamp_ntz")
    h = S.hours_between("s", "p")
    got = [tuple(r) for r in df.select(S.quick_purchase(h), S.instant_purchase(h)).collect()]
    assert [g[0] for g in got] == [0, 1, 1, 1, 1]
    assert [g[1] for g in got] == [0, 0, 0, 1, 1]


def test_risk_and_threshold(spark):
    df = col(spark, [0.2999, 0.3, 0.6, 0.8, 0.5], "double")
    got = [tuple(r) for r in df.select(S.risk_level("x"), S.is_fraud("x", 0.5)).collect()]
    assert [g[0] for g in got] == ["low", "medium", "high", "critical", "medium"]
    assert got[-1][1] == 1  # p == threshold counts as fraud


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 7, 10),)],
                               "t timestamp_ntz")
    got = [tuple(r) for r in df.select(S.day_of_week("t"), S.is_weekend("t")).collect()]
    assert got == [(0, 0), (6, 1)]


def test_browser_source_null_propagates(spark):
    df = spark.createDataFrame([("Chrome", "SEO"), (None, "SEO")], "browser string, source string")
    assert [r[0] for r in df.select(S.browser_source()).collect()] == ["Chrome_SEO", None]


def test_request_times(spark):
    df = spark.createDataFrame([(14, 2, 48.5)], "h int, dow int, gap double")
    p, s = S.request_times("h", "dow", "gap", "2024-03-01")  # a Friday
    r = df.select(p.alias("p"), s.alias("s")).first()
    assert r["p"] == dt.datetime(2024, 3, 6, 14, 0)  # next Wednesday
    assert r["s"] == dt.datetime(2024, 3, 4, 13, 30)


def test_zscore_zero_std(spark):
    df = col(spark, [5.0, 5.0], "double")
    assert [r[0] for r in df.select(S.zscore("x", 5.0, 0.0)).collect()] == [0.0, 0.0]
    assert df.select(F.lit(1)).count() == 2
