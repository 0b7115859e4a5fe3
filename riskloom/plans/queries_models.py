"""Registered queries: model fits, predictions, importances, CV, learning
curve, explanations, scoring and model persistence.

Model outputs are not SQL-expressible, so these keys have no DuckDB
statement (rows-only check); the properties are covered by tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import models as MD
from riskloom.operators.keystate import KeyState
from riskloom.plans import pipeline as PL
from riskloom.plans import training as TR
from riskloom.plans.catalog import query, r6
from riskloom.plans.oracle import sql
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import fixtures as X

BEST = "random_forest"


def _fit_summary(spark, d, model_type, m=None):
    td = TR.commerce_training_data(spark, d)
    m = m or TR.fit(spark, d, model_type, td)
    acc = TR.accuracy_f1(TR.scored(m, td.train)).select(F.col("accuracy").alias("train_accuracy"))
    return r6(acc.select(F.lit(model_type).alias("model"), F.lit(td.n_train).alias("n_train"),
                         F.lit(len(td.features)).alias("n_features"), "train_accuracy"))


@query("model_lr")
def model_lr(spark, d):
    return _fit_summary(spark, d, "logistic_regression")


@query("model_rf")
def model_rf(spark, d):
    return _fit_summary(spark, d, "random_forest")


@query("model_gbt")
def model_gbt(spark, d):
    return _fit_summary(spark, d, "xgboost")


@query("model_train_accuracy")
def model_train_accuracy(spark, d):
    return _fit_summary(spark, d, BEST).select("model", "train_accuracy")


@query("model_train_all")
def model_train_all(spark, d):
    """Every model type on one cached training set; a failure becomes a row."""
    rows = []
    models = TR.fit_all(spark, d, MD.MODEL_TYPES, TR.commerce_training_data(spark, d))
    for t, m in models.items():
        try:
            if isinstance(m, Exception):
                raise m
            r = _fit_summary(spark, d, t, m).select("model", F.lit("ok").alias("status"), "train_accuracy")
        except Exception as e:  # noqa: BLE001 - recorded, the loop continues
            r = spark.createDataFrame([(t, f"failed: {type(e).__name__}", None)],
                                      "model string, status string, train_accuracy double")
        rows.append(r)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("model_predict")
def model_predict(spark, d):
    td = TR.commerce_training_data(spark, d)
    return r6(TR.scored(TR.fit(spark, d, BEST, td), td.test))


@query("model_predict_proba")
def model_predict_proba(spark, d):
    """Both class probabilities (they sum to 1) for the test rows."""
    from pyspark.ml.functions import vector_to_array
    td = TR.commerce_training_data(spark, d)
    out = TR.fit(spark, d, BEST, td).transform(td.test)
    p = vector_to_array(F.col("probability"))
    return r6(out.select("txn_id", p[0].alias("p_normal"), p[1].alias("p_fraud")))


@query("model_importance")
def model_importance(spark, d):
    td = TR.commerce_training_data(spark, d)
    imp = MD.importance(spark, TR.fit(spark, d, BEST, td), td.features)
    return r6(imp)


@query("topk_importance")
def topk_importance(spark, d):
    """Top 10 features by importance (the reported top-k is the feature)."""
    return model_importance(spark, d).orderBy(F.desc("importance"), "feature").limit(10)


@query("model_cv")
def model_cv(spark, d):
    folds = TR.cross_validate(spark, d, "logistic_regression")
    s = TR.cv_summary(folds)
    return r6(folds.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k").drop("_k"))


@query("model_learning_curve")
def model_learning_curve(spark, d):
    return r6(TR.learning_curve(spark, d))


@query("model_train_test_f1")
def model_train_test_f1(spark, d):
    td = TR.commerce_training_data(spark, d)
    rows = []
    for t, m in TR.fit_all(spark, d, MD.MODEL_TYPES, td).items():
        if isinstance(m, Exception):
            raise m
        tr = TR.accuracy_f1(TR.scored(m, td.train)).select(F.col("f1_score").alias("train_f1"))
        te = TR.accuracy_f1(TR.scored(m, td.test)).select(F.col("f1_score").alias("test_f1"))
        rows.append(tr.withColumn("_k", F.lit(1)).join(te.withColumn("_k", F.lit(1)), "_k")
                    .select(F.lit(t).alias("model"), "train_f1", "test_f1",
                            (F.col("train_f1") - F.col("test_f1")).alias("gap")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return r6(out)


@query("explain_contributions")
def explain_contributions(spark, d):
    """Mean absolute contribution per feature and model: exact for the linear
    model, path attribution for forest and boosted trees."""
    out = TR.linear_contributions(spark, d).withColumn("model", F.lit("logistic_regression"))
    for t in ("random_forest", "xgboost"):
        out = out.unionByName(TR.tree_contributions(spark, d, t).withColumn("model", F.lit(t)))
    return r6(out)


# ---------------------------------------------------------------- scoring --

def _saved_scorer(spark, d, model_type=BEST):
    """The whole scorer, saved and loaded again."""
    path = scratch_path(spark, "scorer")
    MD.save_bundle(spark, TR.raw_scorer(spark, d, model_type), path, {"model_type": model_type, "dataset": "fraud", "threshold": 0.5})
    return MD.load_bundle(spark, path)


def _new_rows(spark, d):
    return TR.commerce_training_data(spark, d).raw.where(F.col("is_test") == 1).drop(
        "is_test", "ip_country", "ip_as_int", "class")


@query("score_batch")
def score_batch(spark, d):
    """Raw test rows (no label, no country) through the saved scorer: feature
    build over the batch, imputation, scaling, model, confidence, risk band."""
    model, meta = _saved_scorer(spark, d)
    return r6(PL.score(model, _new_rows(spark, d), meta["threshold"]))


@query("score_details")
def score_details(spark, d):
    return r6(MD.score_details(X.scores(spark, d), 0.5, include_details=True))


sql("score_details", """
select txn_id, label, round(fraud_probability, 6) as fraud_probability,
  cast(fraud_probability >= 0.5 as int) as is_fraud,
  round(greatest(fraud_probability, 1 - fraud_probability), 6) as confidence,
  case when fraud_probability < 0.3 then 'low' when fraud_probability < 0.6 then 'medium'
       when fraud_probability < 0.8 then 'high' else 'critical' end as risk_level
from scores""", "scores")


@query("score_single")
def score_single(spark, d):
    """One raw transaction (the single-row request is the feature) through the same scorer."""
    model, meta = _saved_scorer(spark, d)
    return r6(PL.score(model, _new_rows(spark, d).orderBy("txn_id").limit(1), meta["threshold"]))


def history_state(spark, parts) -> KeyState:
    """A saved per-key state, built part by part."""
    state = KeyState(spark, scratch_path(spark, "key-state"))
    for part in parts:
        state.merge(cut_lineage(part, "part"))
    return state


@query("score_with_history")
def score_with_history(spark, d):
    """Raw purchases of the last day scored by the saved scorer against the
    saved per-key state of all days before: no history is read again."""
    past, new = TR.last_day(spark, d)
    state = history_state(spark, past)
    model, meta = _saved_scorer(spark, d)
    return r6(PL.score(PL.with_state(model, state.path), new, meta["threshold"]))


STATE_FEATURES = ["device_frequency", "users_per_device", "device_usage_count", "device_freq_1h",
                  "ip_frequency", "users_per_ip", "ip_usage_count"]


@query("state_next_day")
def state_next_day(spark, d):
    """Per-key features of the last day from the state of the days before
    (two merges) and that day's rows; equal to those over the full batch."""
    past, new = TR.last_day(spark, d)
    return history_state(spark, past).features(cut_lineage(new, "day")).select("txn_id", *STATE_FEATURES)


sql("state_next_day", """
select txn_id,
  case when device_id is not null then count(*) over (partition by device_id) end as device_frequency,
  u.n as users_per_device,
  case when device_id is not null then row_number() over (partition by device_id order by purchase_time, txn_id) end as device_usage_count,
  case when device_id is not null then
    count(user_id) over (partition by device_id order by purchase_time
                         range between interval '3599999999 microseconds' preceding and current row)
    - count(user_id) over (partition by device_id, purchase_time)
    + count(user_id) over (partition by device_id, purchase_time order by txn_id
                           rows between unbounded preceding and current row) end as device_freq_1h,
  case when ip_address is not null then count(*) over (partition by ip_address) end as ip_frequency,
  v.n as users_per_ip,
  case when ip_address is not null then row_number() over (partition by ip_address order by purchase_time, txn_id) end as ip_usage_count
from commerce_txn t
left join (select device_id as k, count(distinct user_id) as n from commerce_txn group by 1) u on t.device_id = u.k
left join (select ip_address as k, count(distinct user_id) as n from commerce_txn group by 1) v on t.ip_address = v.k
qualify date_trunc('day', purchase_time) = max(date_trunc('day', purchase_time)) over ()""", "commerce_txn")


@query("model_save_load")
def model_save_load(spark, d):
    """Save the whole scorer (feature state, medians, moments, model, IP
    ranges), load it back, score raw rows: identical probabilities."""
    m = TR.raw_scorer(spark, d, BEST)
    m2, meta = _saved_scorer(spark, d)
    new = cut_lineage(_new_rows(spark, d), "raw")
    a = PL.score(m, new).select("txn_id", F.col("fraud_probability").alias("p1"))
    b = PL.score(m2, new).select("txn_id", F.col("fraud_probability").alias("p2"))
    j = a.join(b, "txn_id")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum((F.col("p1") != F.col("p2")).cast("int")).alias("n_different"),
                 F.lit(meta["model_type"]).alias("model_type"),
                 F.lit(len(m2.stages[0].features)).alias("n_features"))


@query("score_eval_existing")
def score_eval_existing(spark, d):
    """Load the saved model, score the test split, accuracy / F1 / AUC."""
    td = TR.commerce_training_data(spark, d)
    path = scratch_path(spark, "model")
    MD.save_bundle(spark, TR.fit(spark, d, BEST, td), path, {"model_type": BEST,
                                                              "features": td.features})
    m, _ = MD.load_bundle(spark, path)
    s = TR.scored(m, td.test)
    basic = TR.accuracy_f1(s)
    auc = M.ScoreCurve.of(s, "class").roc_auc()
    return r6(basic.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k"))
