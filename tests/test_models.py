"""Pipelines: unknown types, probability range, save/load identity, IO errors."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as MD
from riskloom.session import scratch_path
from riskloom.sources import io as IO


def _data(spark):
    return spark.range(400).select(
        F.col("id").alias("txn_id"), (F.col("id") % 7).cast("double").alias("f1"),
        (F.col("id") % 11).cast("double").alias("f2"),
        ((F.col("id") % 7) > 4).cast("int").alias("class"), F.lit(1.0).alias("weight"))


def test_unknown_model_type():
    with pytest.raises(ValueError):
        MD.estimator("nope", ["f1"])


def test_lr_probabilities_and_save_load(spark):
    df = _data(spark)
    m = MD.estimator("logistic_regression", ["f1", "f2"], n_train=400).fit(df)
    s = MD.predict(m, df, keep=["txn_id", "class"])
    r = s.agg(F.min("fraud_probability"), F.max("fraud_probability")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
    path = scratch_path(spark, "t-model")
    MD.save_bundle(spark, m, path, {"features": ["f1", "f2"]})
    m2, meta = MD.load_bundle(spark, path)
    s2 = MD.predict(m2, df, keep=["txn_id"])
    a = {r["txn_id"]: r["fraud_probability"] for r in s.collect()}
    b = {r["txn_id"]: r["fraud_probability"] for r in s2.collect()}
    assert a == b and meta["features"] == ["f1", "f2"]
    imp = MD.importance(spark, m, ["f1", "f2"])
    assert imp.count() == 2


def test_missing_model_raises(spark):
    with pytest.raises(FileNotFoundError):
        MD.load_bundle(spark, scratch_path(spark, "no-model"))


def test_processed_unknown_type(spark):
    with pytest.raises(ValueError):
        IO.save_processed(_data(spark), "nope", scratch_path(spark, "p"))


def test_missing_ip_ranges_is_empty(spark):
    with pytest.warns(UserWarning):
        df = IO.load_ip_ranges(spark, scratch_path(spark, "no-ranges"))
    assert df.count() == 0 and df.columns == ["lower_bound_ip_address", "upper_bound_ip_address", "country"]


def test_prepare_features_unknown_type(spark):
    from riskloom.plans import features as FT
    with pytest.raises(ValueError):
        FT.prepare_features(_data(spark), "nope")


def test_forest_in_parts(spark):
    """On many rows a forest is grown a bounded number of trees at a time: one
    model with all trees, none of them twice; on few rows it is Spark's own."""
    from pyspark.ml.classification import RandomForestClassifier

    from riskloom.operators import trees as T
    assert MD.trees_at_once(1_000, 200) == 200 and MD.trees_at_once(None, 200) == 200
    assert MD.trees_at_once(35_000_000, 200) == MD.trees_at_once(10 ** 12, 200) == 25
    rows = spark.range(900).select(F.col("id").alias("txn_id"), F.rand(1).alias("f1"), F.randn(2).alias("f2"), F.lit(1.0).alias("weight"))
    rows = rows.withColumn("class", ((F.col("f1") + F.col("f2") / 2) > 0.6).cast("int")).cache()
    whole = MD.estimator("random_forest", ["f1", "f2"], n_train=900, numTrees=8, maxDepth=4)
    assert MD.estimator("random_forest", ["f1", "f2"], n_train=10 ** 8).getStages()[1].at_once == 25
    data = whole.getStages()[0].transform(rows)
    plain = RandomForestClassifier(labelCol="class", weightCol="weight", numTrees=8, maxDepth=4, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=42).fit(data)
    assert [t.toDebugString for t in whole.fit(rows).stages[1].trees] and whole.fit(rows).stages[1].toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
    whole.getStages()[1].at_once = 3
    model = whole.fit(rows)
    forest = model.stages[1]
    assert forest.getNumTrees == 8 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 8
    assert forest.getFeaturesCol() == "features" and forest.featureImportances.toArray().sum() == pytest.approx(1.0)
    # the probability is the mean over all eight trees
    got = {r["txn_id"]: r["fraud_probability"] for r in MD.predict(model, rows, keep=["txn_id"]).collect()}
    last = T.staged(rows, T.Ensemble.of(spark, forest), ["f1", "f2"], ["txn_id"]).select("txn_id", F.element_at("margins", -1).alias("m"))
    assert {r["txn_id"]: pytest.approx(r["m"], abs=1e-9) for r in last.collect()} == got
    path = scratch_path(spark, "t-forest")
    MD.save_bundle(spark, model, path, {})
    back, _ = MD.load_bundle(spark, path)
    assert {r["txn_id"]: r["fraud_probability"] for r in MD.predict(back, rows, keep=["txn_id"]).collect()} == got
