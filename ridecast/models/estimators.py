"""Tree ensembles and linear models on MLlib.

The source's learners map onto MLlib as follows (differences noted):

* random forest by squared error -> ``RandomForestRegressor``, depth capped at 30;
* gradient boosting -> ``GBTRegressor`` (squared or absolute loss) and ``GBTClassifier``;
* linear / ridge regression -> ``LinearRegression`` with the normal solver.

Forests by the absolute error, extra trees and second-order boosting are in ``trees``, AdaBoost.R2 over any learner in
``adaboost``.  All fitting runs as Spark jobs over the partitioned training frame; the driver holds models and scalars.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasFitIntercept, HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 30


def clamp_depth(depth) -> int:
    """MLlib trees stop at depth 30; ``None`` (unlimited) and deeper requests map to 30."""
    if depth is None or depth > MAX_DEPTH:
        warnings.warn(f"max depth {'unlimited' if depth is None else depth} becomes {MAX_DEPTH}", stacklevel=2)
        return MAX_DEPTH
    return int(depth)


def feature_subset(max_features) -> str:
    """sklearn ``max_features`` -> MLlib ``featureSubsetStrategy``."""
    if max_features in (None, "auto", 1.0):
        return "all"
    if isinstance(max_features, float):
        return str(max_features)
    if isinstance(max_features, int):
        return str(max_features)
    return str(max_features)


ROWS_PER_PARTITION = 1_000_000
MIN_TRAIN_PARTITIONS = 4


def size_partitions(df: DataFrame, rows: int, key: str, rows_per_partition: int = ROWS_PER_PARTITION,
                    min_partitions: int = MIN_TRAIN_PARTITIONS) -> DataFrame:
    """Partition a training frame by its row count and a hash of ``key`` before it is cached: about
    ``rows_per_partition`` rows per task, and a few tasks at least.  AQE does not coalesce inside a cached plan, so a frame
    out of a 200-way shuffle would otherwise run every tree level as 200 tiny tasks; and as MLlib draws per partition, the
    fitted trees must not depend on how many cores a machine has."""
    return df.repartition(max(-(-rows // rows_per_partition), min_partitions), key)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def features_as_array(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, vector_to_array(col))


def random_forest(n_estimators: int = 100, max_depth=10, min_samples_leaf: int = 1, min_impurity_decrease=0.0,
                  max_features=None, seed: int = 1, bootstrap: bool = True, label: str = "label",
                  features: str = "features", prediction: str = "prediction", max_bins: int = 64):
    return RandomForestRegressor(numTrees=n_estimators, maxDepth=clamp_depth(max_depth),
                                 minInstancesPerNode=min_samples_leaf, minInfoGain=float(min_impurity_decrease),
                                 featureSubsetStrategy=feature_subset(max_features), seed=seed, bootstrap=bootstrap,
                                 labelCol=label, featuresCol=features, predictionCol=prediction, maxBins=max_bins)


def gradient_boosting(n_estimators: int = 100, learning_rate: float = 0.1, max_depth=3, subsample: float = 1.0,
                      max_features=None, loss: str = "squared", seed: int = 1, label: str = "label",
                      features: str = "features", prediction: str = "prediction", max_bins: int = 64):
    return GBTRegressor(maxIter=n_estimators, stepSize=learning_rate, maxDepth=clamp_depth(max_depth),
                        subsamplingRate=subsample, featureSubsetStrategy=feature_subset(max_features),
                        lossType=loss, seed=seed, labelCol=label, featuresCol=features, predictionCol=prediction,
                        maxBins=max_bins)


def gradient_boosting_classifier(n_estimators: int = 100, learning_rate: float = 0.1, max_depth=3,
                                 subsample: float = 1.0, seed: int = 1, label: str = "label",
                                 features: str = "features"):
    from pyspark.ml.classification import GBTClassifier
    return GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=clamp_depth(max_depth),
                         subsamplingRate=subsample, seed=seed, labelCol=label, featuresCol=features)


def linear_regression(label: str = "label", features: str = "features"):
    return LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal", standardization=False,
                            labelCol=label, featuresCol=features)


def ridge(df: DataFrame, alpha: float = 1.0, label: str = "label", features: str = "features"):
    """Ridge with sklearn's objective ||y - Xw - b||^2 + alpha ||w||^2.

    MLlib scales the penalty by the label's std and divides the loss by n, so
    regParam = alpha * std_pop(y) / n gives the same coefficients.  The two
    scalars come from one aggregation job."""
    n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    reg = alpha * (sd or 0.0) / max(n, 1)
    return LinearRegression(regParam=reg, elasticNetParam=0.0, solver="normal", standardization=False,
                            labelCol=label, featuresCol=features)


class Ridge(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol, HasFitIntercept):
    """Ridge with sklearn's objective as an estimator, for searches and boosting; a row counts ``weightCol`` times.  Without
    an intercept it is kernel ridge with the linear kernel, whose dual solution gives the same predictions."""

    alpha = Param(Params._dummy(), "alpha", "penalty of the squared coefficients", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=1.0, fitIntercept=True, featuresCol="features", labelCol="label", predictionCol="prediction",
                 weightCol=None):
        super().__init__()
        self._setDefault(alpha=1.0, fitIntercept=True, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame):
        w = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        y = F.col(self.getLabelCol()).cast("double")
        n, mean = dataset.agg(F.sum(w), F.sum(w * y) / F.sum(w)).first()
        spread = dataset.agg(F.sum(w * (y - F.lit(mean)) * (y - F.lit(mean)))).first()[0] if n else 0.0
        line = LinearRegression(regParam=self.getOrDefault(self.alpha) * math.sqrt((spread or 0.0) / (n or 1.0)) / (n or 1.0), elasticNetParam=0.0,
                                solver="normal", standardization=False, fitIntercept=self.getOrDefault(self.fitIntercept),
                                featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
        return (line.setWeightCol(self.getWeightCol()) if self.isSet(self.weightCol) else line).fit(dataset)


def coefficients_frame(spark, model, names: list[str]) -> DataFrame:
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients)] + [("intercept", float(model.intercept))]
    return spark.createDataFrame(rows, "term string, value double")


# ---------------------------------------------------------------------------
# importances
# ---------------------------------------------------------------------------

def importance_table(spark, model, names: list[str]) -> DataFrame:
    """Feature, importance (4 decimals, half-even), std of the per-tree
    importances and rank (importance desc, name as tie-break).  The per-tree
    table is exploded and aggregated by Spark."""
    def shares(part):
        return part.importances(len(names)) if hasattr(part, "importances") else np.asarray(part.featureImportances.toArray())

    per_tree = [(t, names[j], float(v)) for t, tree in enumerate(model.trees) for j, v in enumerate(shares(tree))]
    pt = spark.createDataFrame(per_tree, "tree int, feature string, importance double")
    std = pt.groupBy("feature").agg(F.stddev_pop("importance").alias("std"))
    total = model.featureImportances
    imp = spark.createDataFrame([(names[j], float(v)) for j, v in enumerate(getattr(total, "toArray", lambda: total)())],
                                "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))          # one row per feature
    return imp.join(std, "feature").select(
        "feature", F.bround("importance", 4).alias("importance"), F.round("std", 6).alias("std"),
        F.row_number().over(w).alias("rank"))
