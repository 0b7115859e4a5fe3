"""The scorer as one pipeline: fit, save, load in another session, equal rows."""

import pyarrow.parquet as pq
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import prep as P
from riskloom.operators.keystate import KeyState
from riskloom.operators.stages import ColumnScaler, ColumnScalerModel, MedianImputer, MedianImputerModel
from riskloom.plans import commerce as C
from riskloom.plans import features as FT
from riskloom.plans import pipeline as PL
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import fixtures as X
from tests.conftest import SF0001


def same(a, b, key="txn_id"):
    assert a.columns == b.columns
    x, y = ({r[key]: tuple(r) for r in d.collect()} for d in (a, b))
    assert x == y and x


def test_impute_and_scale_equal_the_functions(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, float(i), None) for i in range(50)], "txn_id long, a double, b double, c double")
    pipe = Pipeline(stages=[MedianImputer(keepCols=["txn_id"]), ColumnScaler(keepCols=["txn_id"])])
    model = pipe.fit(df)
    pre = FT.Preprocessor(use_smote=False).fit(df, ["a", "b", "c"])
    same(model.transform(df), pre.transform(df))
    path = scratch_path(spark, "t-pipe")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert [type(s) for s in back.stages] == [MedianImputerModel, ColumnScalerModel]
    assert back.stages[0].getOrDefault("keepCols") == ["txn_id"] and back.stages[0].uid == model.stages[0].uid
    same(back.transform(df), model.transform(df))
    # an unfitted pipeline is saved and loaded as well
    pipe.write().overwrite().save(path + "-est")
    same(Pipeline.load(path + "-est").fit(df).transform(df), model.transform(df))


def test_without_state_it_says_so(spark):
    df = spark.range(3)
    for stage in (MedianImputerModel(), ColumnScalerModel(), PL.FeatureEngineerModel()):
        with pytest.raises(RuntimeError, match="no fitted state"):
            stage.transform(df)


@pytest.fixture(scope="module")
def commerce(spark):
    raw = cut_lineage(X.commerce_txn(spark, SF0001), "raw")
    split = P.stratified_split(raw)
    train = cut_lineage(split.where("is_test = 0").drop("is_test"), "train")
    model = PL.fit_scorer(train, "logistic_regression", ranges=X.ip_ranges(spark, SF0001), oversample=True)
    return raw, train, model


def test_raw_rows_score_alike_in_another_session(spark, commerce):
    raw, train, model = commerce
    path = scratch_path(spark, "t-scorer")
    model.write().overwrite().save(path)
    other = spark.newSession()
    back = PipelineModel.load(path)
    assert back.stages[0].features == model.stages[0].features and len(back.stages[0].features) > 20
    new = raw.drop("class")
    rows = other.createDataFrame(new.collect(), new.schema)
    a, b = PL.score(model, new), PL.score(back, rows)
    same(a, b)
    assert a.count() == raw.count() and a.where("fraud_probability between 0 and 1").count() == raw.count()


def test_features_equal_the_plain_feature_build(spark, commerce):
    raw, train, model = commerce
    state = FT.fit_feature_state(C.with_country(train, X.ip_ranges(spark, SF0001)), "fraud")
    want = FT.prepare_features(raw, "fraud", state=state, ranges=X.ip_ranges(spark, SF0001))
    got = model.stages[0].transform(raw)
    names = model.stages[0].features
    assert set(names) == set(want.columns) - {"txn_id", "class"}
    same(got.select("txn_id", *names), want.select("txn_id", *[F.col(c).cast("double").alias(c) for c in names]))


def test_state_instead_of_the_batch(spark, commerce):
    raw, _, model = commerce
    cut = raw.selectExpr("percentile_approx(purchase_time, 0.6) as t").first()["t"]
    past, new = cut_lineage(raw.where(F.col("purchase_time") < F.lit(cut)), "past"), raw.where(F.col("purchase_time") >= F.lit(cut))
    state = KeyState(spark, scratch_path(spark, "t-score-state"))
    state.merge(past)
    whole = PL.score(model, raw).join(new.select("txn_id"), "txn_id")
    same(PL.score(PL.with_state(model, state.path), new), whole.select(PL.score(model, raw).columns))
    assert model.stages[0].getOrDefault("statePath") == ""


def test_card_preparation(spark):
    t = P.stratified_split(X.card_txn(spark, SF0001))
    model = PL.preparation("creditcard").fit(t.where("is_test = 0").drop("is_test"))
    out = model.transform(t.drop("is_test").withColumn("surplus", F.lit(1.0)))
    assert out.columns == ["txn_id", "class", *model.stages[0].features]
    path = scratch_path(spark, "t-card")
    model.write().overwrite().save(path)
    same(PipelineModel.load(path).transform(t.drop("is_test")), model.transform(t.drop("is_test")))


def test_training_data_follows_the_tables(spark, tmp_path):
    """The memo holds one session's data for tables as they are."""
    import shutil

    from riskloom.plans import training as TR
    for name in ("events", "nation", "region"):
        shutil.copy(f"{SF0001}/{name}.parquet", tmp_path / f"{name}.parquet")
    a = TR.commerce_training_data(spark, str(tmp_path), use_smote=False)
    assert TR.commerce_training_data(spark, str(tmp_path), use_smote=False) is a
    pq.write_table(pq.read_table(f"{SF0001}/events.parquet").slice(0, 600), tmp_path / "events.parquet")
    b = TR.commerce_training_data(spark, str(tmp_path), use_smote=False)
    assert b is not a and b.n_train < a.n_train
    assert TR.commerce_training_data(spark, str(tmp_path), use_smote=False) is b


def test_fits_run_side_by_side(spark, monkeypatch):
    """Several fits at once while their rows fit beside each other, else one
    after the other; a failure is that model's alone."""
    import threading
    from types import SimpleNamespace

    from riskloom.plans import training as TR
    together = threading.Barrier(3)

    def fit(spark, d, t, td):
        if td.n_train < TR.SIDE_BY_SIDE_ROWS:
            together.wait(20)           # nobody goes on before all three are here
        if t == "b":
            raise ValueError(t)
        return t.upper()
    monkeypatch.setattr(TR, "fit", fit)
    for n in (10, TR.SIDE_BY_SIDE_ROWS + 1):
        got = TR.fit_all(spark, "d", ("a", "b", "c"), SimpleNamespace(n_train=n))
        assert list(got) == ["a", "b", "c"] and (got["a"], got["c"]) == ("A", "C") and isinstance(got["b"], ValueError)


def test_large_training_tables_are_dealt_evenly(spark, monkeypatch):
    from riskloom.plans import training as TR
    monkeypatch.setattr(TR, "EVEN_ROWS", 1000)
    cores = spark.sparkContext.defaultParallelism
    uneven = spark.range(0, 900, numPartitions=1).union(spark.range(900, 1003, numPartitions=1))
    assert TR._evenly(uneven, 1000) is uneven
    sizes = TR._evenly(uneven, 1003).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == cores and max(r["count"] for r in sizes) <= 1003 / cores + 2
    monkeypatch.setattr(TR, "FILE_ROWS", 100)
    assert TR._evenly(uneven, 1003).rdd.getNumPartitions() == cores * -(-1003 // (cores * 100))


def test_a_fold_is_oversampled_once(spark, monkeypatch):
    """The fit's passes read a fold's rows from a table, which goes when it is fitted."""
    from riskloom.operators import models as MD
    from riskloom.plans import training as TR
    from riskloom.session import path_exists
    seen, weigh = [], MD.weight_for

    def weight_for(model_type, df, label):
        seen.append(df)
        return weigh(model_type, df, label)
    monkeypatch.setattr(MD, "weight_for", weight_for)
    monkeypatch.setattr(TR, "DEFAULTS", type(TR.DEFAULTS)(lr_max_iter=3))
    folds = TR.cross_validate(spark, SF0001, "logistic_regression", k=2)
    assert len(seen) == 2 and {r["fold"] for r in folds.collect()} == {0, 1}
    for df in seen:
        assert "Join" not in df._jdf.queryExecution().logical().toString()
        assert not path_exists(spark, df.inputFiles()[0])
