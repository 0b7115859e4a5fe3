"""Ranking metrics, threshold search and the two-level prefix sums."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from tests.conftest import SF001


def _small(spark):
    return spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, fraud_probability double")


def test_auc_and_ap_small(spark):
    c = M.ScoreCurve.of(_small(spark))
    assert c.roc_auc().first()[0] == pytest.approx(0.75)
    assert c.average_precision().first()[0] == pytest.approx(0.8333333333)


def test_fixture_values(spark):
    from riskloom.sources import fixtures as X
    c = M.ScoreCurve.of(X.scores(spark, SF001))
    assert c.roc_auc().first()[0] == pytest.approx(0.836897109, abs=1e-9)
    assert c.average_precision().first()[0] == pytest.approx(0.772460258, abs=1e-9)


def test_bucket_count_does_not_change_prefix(spark):
    from riskloom.sources import fixtures as X
    sc = X.scores(spark, SF001)
    a = M.ScoreCurve.of(sc, buckets=1).points
    b = M.ScoreCurve.of(sc, buckets=37).points
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_auc_symmetric_under_negation(spark):
    from riskloom.sources import fixtures as X
    sc = X.scores(spark, SF001)
    a = M.ScoreCurve.of(sc).roc_auc().first()[0]
    b = M.ScoreCurve.of(sc.withColumn("fraud_probability", -F.col("fraud_probability"))).roc_auc().first()[0]
    assert a + b == pytest.approx(1.0)


def test_one_class_confusion_is_2x2(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, fraud_probability double")
    r = M.confusion(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 0, 0)
    b = M.basic_from_confusion(M.confusion(df)).first()
    assert b.precision == 0.0 and b.recall == 0.0 and b.f1_score == 0.0 and b.accuracy == 1.0


def test_grids():
    g = M.arange_grid(0.05, 0.60, 0.01)
    assert len(g) == 55 and g[-1] == pytest.approx(0.59)
    s = M.linspace_grid(0.05, 0.95, 19)
    assert len(s) == 19 and s[-1] == 0.95


def test_grid_counts_match_direct_counts(spark):
    from riskloom.sources import fixtures as X
    sc = X.scores(spark, SF001)
    gc = {r.threshold: (r.tp, r.fp) for r in M.grid_counts(sc, [0.1, 0.5, 0.9]).collect()}
    for t, (tp, fp) in gc.items():
        assert tp == sc.where((F.col("fraud_probability") >= t) & (F.col("label") == 1)).count()
        assert fp == sc.where((F.col("fraud_probability") >= t) & (F.col("label") == 0)).count()


def test_argmax_end_point_maps_to_max_score(spark):
    c = M.ScoreCurve.of(_small(spark))
    r = c.argmax_threshold("precision").first()
    # precision 1.0 first reached at threshold 0.8 (ascending order wins)
    assert r.threshold == 0.8 and r.curve_precision == 1.0
    with pytest.raises(ValueError):
        c.argmax_threshold("nope")


def test_min_recall_falls_back(spark):
    c = M.ScoreCurve.of(_small(spark))
    r = c.argmax_threshold("f1", min_recall=1.01).first()  # impossible constraint -> unrestricted
    u = c.argmax_threshold("f1").first()
    assert r.threshold == u.threshold and not math.isnan(r.f1_score)
