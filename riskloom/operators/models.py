"""Classifiers (pyspark.ml), scoring projections, importances, persistence.

Every model is a ``PipelineModel`` of ``VectorAssembler`` + classifier, so
training and scoring share one saved object; fitted feature/preprocessing
state and the feature order travel with it in a small metadata table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DEFAULTS
from riskloom.functions import scalar as S

MODEL_TYPES = ("logistic_regression", "random_forest", "xgboost")

TREES_AT_ONCE = 25          # of a forest on many rows
BAG_ENTRIES = 2 ** 27       # rows x trees that are grown at once in any case
_SEED_STEP = 1_000_003      # Spark adds the partition's number to the seed


def trees_at_once(n_rows: int | None, trees: int) -> int:
    """How many trees of a forest are grown together: all of them on few rows."""
    return min(trees, max(TREES_AT_ONCE, BAG_ENTRIES // max(n_rows or 1, 1)))


class ForestInParts(RandomForestClassifier):
    """A random forest grown ``at_once`` trees at a time, as one model.

    Spark keeps, for every row, how often each tree drew it and the node it has
    reached in each tree: 16 bytes a row and tree with the copies it holds
    while a level is split.  For 200 trees that is many times the training
    table and spills; a level's statistics of all trees don't fit a cache
    either.  Trees of a forest don't depend on each other, so they are grown
    in parts with seeds of their own and put together.  With one part it is
    Spark's forest as it is.
    """

    def __init__(self, at_once: int, **params):
        super().__init__(**params)
        self.at_once = at_once

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        trees, seed = self.getNumTrees(), self.getSeed()
        if trees <= self.at_once:
            return super()._fit(dataset)
        parts = []
        for i, first in enumerate(range(0, trees, self.at_once)):
            own = {self.numTrees: min(self.at_once, trees - first), self.seed: seed + i * _SEED_STEP}
            parts.append(super(ForestInParts, self.copy(own))._fit(dataset))
        return self._joined(parts)

    def _joined(self, parts: list) -> RandomForestClassificationModel:
        """All parts' trees as one model with this estimator's parameters."""
        sc = SparkSession.active().sparkContext
        jvm = sc._jvm.org.apache.spark.ml.classification
        members = [t for m in parts for t in m._java_obj.trees()]
        array = sc._gateway.new_array(jvm.DecisionTreeClassificationModel, len(members))
        for i, t in enumerate(members):
            array[i] = t
        java = jvm.RandomForestClassificationModel(parts[0].uid, array, parts[0].numFeatures, parts[0].numClasses)
        model = RandomForestClassificationModel(java)
        model._resetUid(parts[0].uid)
        self._copyValues(model)
        model._transfer_params_to_java()
        return model


def estimator(model_type: str, features: Sequence[str], label: str = "class",
              weight_col: str | None = "weight", n_train: int | None = None,
              **overrides) -> Pipeline:
    """Assembler + classifier with the modelled application's defaults.

    * logistic_regression: L2, ``regParam = 1 / n`` (C = 1 on summed loss),
      no internal standardisation (inputs are already scaled);
    * random_forest: 200 trees, depth 10, min 5 rows per leaf, sqrt features;
    * xgboost: the nearest Spark estimator, ``GBTClassifier`` with 200
      rounds, depth 4, step 0.05, row and column subsampling 0.8.
    """
    d = DEFAULTS
    common = dict(featuresCol="features", labelCol=label)
    if weight_col:
        common["weightCol"] = weight_col
    if model_type == "logistic_regression":
        params = dict(maxIter=d.lr_max_iter, regParam=1.0 / max(n_train or 1, 1), elasticNetParam=0.0,
                      standardization=False, **common)
        params.update(overrides)
        clf = LogisticRegression(**params)
    elif model_type == "random_forest":
        # maxMemoryInMB / cacheNodeIds / checkpointInterval are execution
        # settings only: more tree nodes are split per pass over the data, and
        # node ids are cached instead of re-shipping the trees (a lineage of
        # one step per level needs no checkpoint); the forest is unchanged
        params = dict(numTrees=d.rf_trees, maxDepth=d.rf_depth, minInstancesPerNode=d.rf_min_leaf,
                      featureSubsetStrategy="sqrt", seed=d.seed, maxMemoryInMB=1024,
                      cacheNodeIds=True, checkpointInterval=-1, **common)
        params.update(overrides)
        clf = ForestInParts(trees_at_once(n_train, params["numTrees"]), **params)
    elif model_type == "xgboost":
        params = dict(maxIter=d.gbt_rounds, maxDepth=d.gbt_depth, stepSize=d.gbt_step,
                      subsamplingRate=d.gbt_subsample, featureSubsetStrategy=str(d.gbt_subsample),
                      seed=d.seed, **common)
        params.update(overrides)
        clf = GBTClassifier(**params)
    else:
        raise ValueError(f"Unknown model type: {model_type}")
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, clf])


def curve_estimator(features: Sequence[str], label: str = "class", weight_col: str | None = "weight") -> Pipeline:
    """Boosted trees in the setting of the learning curve: fewer, deeper rounds
    in larger steps, all rows weighing the same."""
    d = DEFAULTS
    return estimator("xgboost", features, label, weight_col, maxIter=d.curve_rounds, maxDepth=d.curve_depth, stepSize=d.curve_step)


def weight_for(model_type: str, df: DataFrame, label: str = "class", out: str = "weight") -> DataFrame:
    """'balanced' weights for LR/RF, fixed positive weight for the boosted trees."""
    from riskloom.operators.prep import with_class_weight
    if model_type == "xgboost":
        return with_class_weight(df, label, out, positive_weight=DEFAULTS.gbt_pos_weight)
    return with_class_weight(df, label, out)


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5,
            keep: Sequence[str] | None = None) -> DataFrame:
    """``fraud_probability`` (P(class 1)) and ``prediction`` (p >= threshold)."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    cols = list(keep) if keep is not None else [c for c in df.columns]
    return out.select(*cols, p.alias("fraud_probability"),
                      S.is_fraud(p, threshold).alias("prediction"))


def score_details(scored: DataFrame, threshold: float = 0.5, include_details: bool = True,
                  p: str = "fraud_probability") -> DataFrame:
    """is_fraud, fraud_probability [, confidence, risk_level]."""
    cols = [S.is_fraud(p, threshold).alias("is_fraud")]
    if include_details:
        cols += [S.confidence(p).alias("confidence"), S.risk_level(p).alias("risk_level")]
    keep = [c for c in scored.columns if c not in ("is_fraud", "confidence", "risk_level", "prediction")]
    return scored.select(*keep, *cols)


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance) descending: |coef| for LR, impurity/gain importances for trees."""
    clf = model.stages[-1]
    if hasattr(clf, "coefficients"):
        vals = [abs(float(v)) for v in clf.coefficients.toArray()]
    else:
        vals = [float(v) for v in clf.featureImportances.toArray()]
    rows = list(zip(features, vals))
    return spark.createDataFrame(rows, "feature string, importance double")


# ------------------------------------------------------------ persistence --

def save_bundle(spark: SparkSession, model: PipelineModel, path: str, meta: dict) -> str:
    """PipelineModel under ``path/model`` and metadata JSON under ``path/meta``."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/meta")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    try:
        model = PipelineModel.load(f"{path}/model")
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no saved model at {path}: {e}") from e
    return model, meta
