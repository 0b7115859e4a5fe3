"""As-of range join: nearest lower bound, then the upper-bound check."""

from riskloom.operators.asof import RangeIndex, asof_range_join, broadcast_range_join


def _data(spark):
    pts = spark.createDataFrame([(1, 5), (2, 15), (3, 25), (4, None)], "id int, ip bigint")
    rng = spark.createDataFrame([(0, 100, "A"), (10, 11, "B"), (10, 19, "C"), (12, 13, "D")],
                                "lo bigint, hi bigint, country string")
    return pts, rng


def test_nearest_lower_then_upper_check(spark):
    pts, rng = _data(spark)
    out = asof_range_join(pts, "ip", rng, "lo", "hi", ["country"])
    got = {r["id"]: r["country"] for r in out.collect()}
    assert got == {1: "A", 2: None, 3: None, 4: None}


def test_broadcast_and_index_agree(spark):
    pts, rng = _data(spark)
    a = sorted(tuple(r) for r in asof_range_join(pts, "ip", rng, "lo", "hi", ["country"]).collect())
    b = sorted(tuple(r) for r in broadcast_range_join(pts, "ip", rng, "lo", "hi", ["country"]).collect())
    c = sorted(tuple(r) for r in RangeIndex(rng, "lo", "hi", ["country"]).join(pts, "ip").collect())
    assert a == b == c


def test_left_rows_preserved_with_empty_ranges(spark):
    pts, rng = _data(spark)
    out = asof_range_join(pts, "ip", rng.limit(0), "lo", "hi", ["country"])
    assert out.count() == 4
    assert all(r["country"] is None for r in out.collect())


def test_matches_fixture_expectation(spark):
    from tests.conftest import SF001
    from riskloom.plans.catalog import commerce_geo
    g = commerce_geo(spark, SF001)
    assert g.count() == 10000
    assert g.where("ip_country is not null").count() == 6508
