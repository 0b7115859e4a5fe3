"""Training jobs: data -> features -> split -> preprocess -> fit -> evaluate.

Order follows the modelled notebook: batch features over the whole batch,
then the stratified split; label-dependent state (the high-risk country
set), medians and moments are fitted on the training split only.  The
training matrix is checkpointed into the shared checkpoint folder, so a
lost executor does not replay the feature build and the oversampling.
Fitted models are memoised per session, data folder, state of its tables and
model type: every query that needs "the random forest" reuses one fit, and a
changed table or another session gets its own.  ``clear`` forgets them all.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DEFAULTS
from riskloom.operators import metrics as M
from riskloom.operators import models as MD
from riskloom.operators import prep as P
from riskloom.operators import trees as TR
from riskloom.plans import commerce as C
from riskloom.plans import features as FT
from riskloom.session import cut_lineage, drop_scratch, path_stamp
from riskloom.sources import fixtures as X

KEY, LABEL = "txn_id", "class"


@dataclass
class TrainingData:
    train: DataFrame          # preprocessed (+ oversampled) training rows
    test: DataFrame           # preprocessed test rows
    features: list
    feature_state: FT.FeatureState
    preprocessor: FT.Preprocessor
    n_train: int
    raw: DataFrame            # all raw rows with country and is_test
    tables: tuple = ()        # further tables that the above read


_DATA: dict = {}
_MODELS: dict = {}
_SOURCES = ("events", "nation", "region")
EVEN_ROWS = 1_000_000        # from here on the training table is dealt evenly to its files
FILE_ROWS = 2_000_000
SIDE_BY_SIDE_ROWS = 8_000_000   # above, the rows that several fits cache don't fit beside each other


def _memo(spark: SparkSession, sf_dir: str, *what) -> tuple:
    stamps = tuple(path_stamp(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _SOURCES)
    key = (spark.sparkContext.applicationId, sf_dir, stamps, *what)
    # what belongs to a session that has ended, or to tables as they were, is of no use any more
    for memo in (_DATA, _MODELS):
        for old in [k for k in list(memo) if k[0] != key[0] or (k[1] == key[1] and k[2] != key[2])]:
            memo.pop(old, None)
    return key


def clear() -> None:
    """Forget all training data and models; their tables are deleted."""
    for td in _DATA.values():
        drop_scratch(td.train, td.raw, *td.tables)
    _DATA.clear()
    _MODELS.clear()


def commerce_training_data(spark: SparkSession, sf_dir: str, use_smote: bool = DEFAULTS.oversample
                           ) -> TrainingData:
    memo = _memo(spark, sf_dir, "fraud", use_smote)
    if memo in _DATA:
        return _DATA[memo]
    raw = C.with_country(X.commerce_txn(spark, sf_dir), X.ip_ranges(spark, sf_dir))
    # read by the state fit, the skew probe and the feature build: materialise once
    split = cut_lineage(P.stratified_split(raw, LABEL, KEY, DEFAULTS.test_size, DEFAULTS.seed))
    state = FT.fit_feature_state(split.where(F.col("is_test") == 0), "fraud", LABEL)
    feats = FT.prepare_features(split, "fraud", state=state, keep=(KEY, "is_test"), materialize=False)
    feats = cut_lineage(feats)
    features = [c for c in feats.columns if c not in (KEY, LABEL, "is_test")]
    train, test = feats.where(F.col("is_test") == 0), feats.where(F.col("is_test") == 1)
    pre = FT.Preprocessor(use_smote=use_smote)
    tr = pre.fit_transform(train.drop("is_test"), features, label=LABEL, key=KEY)
    tr = cut_lineage(_evenly(tr, feats.count()))
    te = pre.transform(test.drop("is_test"))
    td = TrainingData(tr, te, features, state, pre, tr.count(), split, (feats,))
    _DATA[memo] = td
    return td


def _evenly(df: DataFrame, n: int) -> DataFrame:
    """Large tables in as many equal parts as there are cores, or a multiple:
    each pass of a fit waits for the largest part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-n // (cores * FILE_ROWS)))) if n > EVEN_ROWS else df


def fit(spark: SparkSession, sf_dir: str, model_type: str, td: TrainingData | None = None
        ) -> PipelineModel:
    memo = _memo(spark, sf_dir, model_type)
    if memo in _MODELS:
        return _MODELS[memo]
    td = td or commerce_training_data(spark, sf_dir)
    data = MD.weight_for(model_type, td.train, LABEL)
    model = MD.estimator(model_type, td.features, LABEL, "weight", n_train=td.n_train).fit(data)
    _MODELS[memo] = model
    return model


def fit_all(spark: SparkSession, sf_dir: str, model_types, td: TrainingData) -> dict:
    """Model type -> model, or the exception that its fit ended with.  Fits
    leave cores idle between their many short passes, so they run side by side
    while the rows they cache fit beside each other."""
    def one(t):
        try:
            return fit(spark, sf_dir, t, td)
        except Exception as e:  # noqa: BLE001 - the caller's to raise or record
            return e
    at_once = len(model_types) if td.n_train <= SIDE_BY_SIDE_ROWS else 1
    tasks = [inheritable_thread_target(spark)(partial(one, t)) for t in model_types]    # each with local properties of its own
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(model_types, pool.map(lambda task: task(), tasks)))


def raw_scorer(spark: SparkSession, sf_dir: str, model_type: str) -> PipelineModel:
    """The fitted parts as one PipelineModel that scores raw purchases."""
    from riskloom.plans.pipeline import assemble
    td = commerce_training_data(spark, sf_dir)
    return assemble(td.feature_state, td.features, td.preprocessor, fit(spark, sf_dir, model_type, td),
                    X.ip_ranges(spark, sf_dir), LABEL, KEY)


def _from_newest_day(spark: SparkSession, sf_dir: str, days: int) -> tuple:
    """(purchases, day of each, the day ``days`` before the newest)."""
    raw = X.commerce_txn(spark, sf_dir)
    newest = raw.agg(F.max(F.date_trunc("day", "purchase_time")).alias("d")).first()["d"]
    return raw, F.date_trunc("day", "purchase_time"), F.lit(newest) - F.make_interval(days=F.lit(days))


def last_day(spark: SparkSession, sf_dir: str):
    """(purchases before the last day, in two parts; those of the last day):
    the past that a state is built from, and the rows to be scored."""
    raw, day, week = _from_newest_day(spark, sf_dir, 7)
    _, _, cut = _from_newest_day(spark, sf_dir, 0)
    return [raw.where(day < week), raw.where((day >= week) & (day < cut))], raw.where(day >= cut)


def last_week(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(purchases before the last seven days, those of the last seven days)."""
    raw, day, cut = _from_newest_day(spark, sf_dir, 6)
    return raw.where(day < cut), raw.where(day >= cut)


def scored(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return MD.predict(model, df, threshold, keep=[KEY, LABEL])


def accuracy_f1(scored_df: DataFrame) -> DataFrame:
    cm = M.confusion(scored_df, LABEL, pred="prediction")
    return M.basic_from_confusion(cm).select("accuracy", "f1_score")


# ------------------------------------------------------------ cross-val --

def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = LABEL,
                     key: str = KEY) -> DataFrame:
    """``fold`` = (rank within class in hash order) mod k: exact per-class balance."""
    from riskloom.operators.balance import dense_index
    parts = []
    for c in [r[label] for r in df.select(label).distinct().collect()]:  # the label values
        part = df.where(F.col(label) == c)
        part = dense_index(part, F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key, "_r")
        parts.append(part.withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(spark: SparkSession, sf_dir: str, model_type: str, k: int = DEFAULTS.cv_folds,
                   use_smote: bool = DEFAULTS.oversample) -> DataFrame:
    """k-fold stratified CV on the (preprocessed, not oversampled) training
    rows; oversampling, when on, is applied inside each training fold."""
    from riskloom.operators.balance import smote
    td = commerce_training_data(spark, sf_dir, use_smote=False)
    folded = cut_lineage(stratified_folds(td.train, k))
    rows = []
    for f in range(k):
        tr = folded.where(F.col("fold") != f).drop("fold")
        va = folded.where(F.col("fold") == f).drop("fold")
        if use_smote:
            # counted, weighted and read by each pass of the fit: made once
            tr = cut_lineage(smote(tr, td.features, LABEL, KEY, DEFAULTS.oversample_ratio, DEFAULTS.smote_k,
                                   DEFAULTS.seed, synthetic_flag=None), "fold")
        n = tr.count()
        m = MD.estimator(model_type, td.features, LABEL, "weight", n_train=n).fit(
            MD.weight_for(model_type, tr, LABEL))
        drop_scratch(tr)
        s = scored(m, va)
        acc = accuracy_f1(s).select("accuracy")
        ap = M.ScoreCurve.of(s, LABEL, "fraud_probability").average_precision()
        rows.append(acc.withColumn("_k", F.lit(1)).join(ap.withColumn("_k", F.lit(1)), "_k")
                    .select(F.lit(f).alias("fold"), "accuracy", "average_precision"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return cut_lineage(out, "folds")        # one row per fold; the summary reads it as well


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("cv_mean_accuracy"),
                     F.stddev_pop("accuracy").alias("cv_std_accuracy"),
                     F.avg("average_precision").alias("cv_mean_average_precision"),
                     F.count(F.lit(1)).alias("folds"))


# -------------------------------------------------------- learning curve --

def curve_model(spark: SparkSession, sf_dir: str, td: TrainingData) -> PipelineModel:
    memo = _memo(spark, sf_dir, "curve")
    if memo not in _MODELS:
        rows = P.with_class_weight(td.train, LABEL, "weight", positive_weight=DEFAULTS.curve_pos_weight)
        _MODELS[memo] = MD.curve_estimator(td.features, LABEL).fit(rows)
    return _MODELS[memo]


def round_metrics(df: DataFrame, ensemble: TR.Ensemble, features: list, label: str = LABEL, weight: str | None = None,
                  ranges: int | None = None) -> DataFrame:
    """(round, logloss, auc, error) of boosted trees after each round on
    ``df``: one pass gives every row's staged margins, as sums per round and as
    sorted runs whose ranges meet in one AUC per round.  The loss is Spark's:
    twice the log of 1 + exp(-2 y margin), y in -1 and 1, weighted."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = cut_lineage(TR.staged_sums(df, ensemble, features, F.col(label), w, ranges), "margins")
    sums = parts.groupBy("round").agg((F.sum("loss") / F.sum("weight")).alias("logloss"),
                                      F.try_divide(F.sum("wrong").cast("double"), F.sum("labelled")).alias("error"))
    return sums.join(M.auc_of_ranges(parts, "round"), "round").withColumnRenamed("roc_auc", "auc")


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, setting of the learning curve: log loss, AUC and error
    after every round on train and validation rows, and the overfit flag
    (train - validation AUC of the whole model > 0.05)."""
    td = commerce_training_data(spark, sf_dir)
    model = curve_model(spark, sf_dir, td)
    ensemble = TR.Ensemble.of(spark, model.stages[-1])
    names = ("logloss", "auc", "error")
    tr = round_metrics(td.train, ensemble, td.features).select("round", *[F.col(c).alias(f"train_{c}") for c in names])
    va = round_metrics(td.test, ensemble, td.features).select("round", *[F.col(c).alias(f"validation_{c}") for c in names])
    curve = cut_lineage(tr.join(va, "round"), "curve")      # one row per round
    last = curve.orderBy(F.desc("round")).first()
    gap = (last["train_auc"] or 0.0) - (last["validation_auc"] or 0.0)
    return curve.withColumn("overfit", F.lit(int(gap > 0.05))).orderBy("round")


# --------------------------------------------------------------- explain --

def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact additive contributions of the linear model, mean |coef * (x - mean)|
    per feature over all test rows (one projection + one aggregate)."""
    td = commerce_training_data(spark, sf_dir)
    model = fit(spark, sf_dir, "logistic_regression", td)
    coef = [float(v) for v in model.stages[-1].coefficients.toArray()]
    means = td.train.agg(*[F.avg(F.col(f)).alias(f) for f in td.features]).first().asDict()
    aggs = [F.avg(F.abs(F.lit(c) * (F.col(f) - F.lit(float(means[f] or 0.0))))).alias(f)
            for f, c in zip(td.features, coef)]
    wide = td.test.agg(*aggs)
    from riskloom.operators.aggregates import unpivot_wide
    return unpivot_wide(wide, td.features, "feature", "mean_abs_contribution").orderBy(
        F.desc("mean_abs_contribution"), "feature")


def tree_contributions(spark: SparkSession, sf_dir: str, model_type: str) -> DataFrame:
    """Mean |contribution| per feature over all test rows, by path attribution
    through every tree; base value and output add up row by row."""
    td = commerce_training_data(spark, sf_dir)
    ensemble = TR.Ensemble.of(spark, fit(spark, sf_dir, model_type, td).stages[-1])
    rows = TR.contributions(td.test, ensemble, td.features, [KEY])
    names = spark.createDataFrame(list(enumerate(td.features)), "pos int, feature string")
    means = rows.select(F.posexplode("contributions").alias("p", "x")).groupBy("p").agg(F.avg(F.abs("x")).alias("mean_abs_contribution"))
    return means.join(F.broadcast(names), F.col("p") == F.col("pos")).select("feature", "mean_abs_contribution").orderBy(
        F.desc("mean_abs_contribution"), "feature")
