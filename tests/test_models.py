"""Model operators: schema, determinism under fixed seeds, and error below the
predict-the-mean baseline on a learnable fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridecast.models.ensemble import bag_predict, oof_group_mean, oof_predict, stack
from ridecast.models.estimators import assemble, gradient_boosting, importance_table, random_forest, ridge
from ridecast.models.search import build_grid, cross_validate, rank_results, sample_grid
from ridecast.operators.folds import kfold_ntile

FEATS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(0, 1500).select(
        F.col("id").alias("ride_id"), (F.col("id") % 10).cast("double").alias("x1"),
        ((F.col("id") * 7) % 5).cast("double").alias("x2"), ((F.col("id") * 13) % 3).cast("double").alias("x3"))
    df = df.withColumn("label", 2 * F.col("x1") + F.col("x2") + ((F.col("ride_id") * 31) % 7 - 3) / 10.0)
    df = assemble(df, FEATS)
    train = kfold_ntile(df.where(F.col("ride_id") < 1000), "ride_id", k=3).persist()
    score = df.where(F.col("ride_id") >= 1000)
    return train, score


def _mae(df, p="prediction"):
    return df.agg(F.avg(F.abs(F.col("label") - F.col(p)))).first()[0]


def _baseline(train, score):
    m = train.agg(F.avg("label")).first()[0]
    return score.agg(F.avg(F.abs(F.col("label") - m))).first()[0]


def test_bagged_forest_beats_mean_and_is_deterministic(data):
    train, score = data
    est = lambda s: random_forest(n_estimators=10, max_depth=6, seed=s)
    p1 = bag_predict(est, train, score, [1, 2])
    p2 = bag_predict(est, train, score, [1, 2])
    a = sorted((r.ride_id, r.prediction) for r in p1.collect())
    b = sorted((r.ride_id, r.prediction) for r in p2.collect())
    assert a == b
    assert _mae(p1) < 0.5 * _baseline(train, score)


def test_gbt_and_mae_loss(data):
    train, score = data
    for loss in ("squared", "absolute"):
        m = gradient_boosting(n_estimators=10, max_depth=4, learning_rate=0.3, loss=loss, seed=1).fit(train)
        assert _mae(m.transform(score)) < 0.5 * _baseline(train, score)


def test_importances_and_ridge(spark, data):
    train, _ = data
    m = random_forest(n_estimators=5, max_depth=5, seed=1).fit(train)
    t = importance_table(spark, m, FEATS).orderBy("rank").collect()
    assert t[0].feature == "x1" and [r.rank for r in t] == [1, 2, 3]
    one = assemble(train.select("x1", "label"), ["x1"], "f1")
    rm = ridge(one, alpha=3.0, features="f1").fit(one)
    x = np.array([r.x1 for r in train.select("x1").collect()])
    y = np.array([r.label for r in train.select("label").collect()])
    slope = np.cov(x, y, bias=True)[0, 1] / (x.var() + 3.0 / len(x))
    assert rm.coefficients[0] == pytest.approx(slope, rel=1e-6)


def test_oof_and_stack(spark, data):
    train, score = data
    learners = {"rf": lambda df: random_forest(n_estimators=5, max_depth=5, seed=1).fit(df)}
    oof, s = oof_predict(learners, train, "fold", 3, score)
    assert oof.count() == train.count() and oof.where("oof_rf IS NULL").count() == 0
    assert "oof_rf" in s.columns
    pred = stack(learners, lambda df: random_forest(n_estimators=5, max_depth=4, seed=1).fit(df),
                 train, score, "fold", 3, FEATS, restack=True)
    assert pred.count() == score.count() and _mae(pred) < _baseline(train, score)


def test_oof_group_mean_brute_force(spark):
    rows = [(i, i % 3, float(i), i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g int, y double, fold int")
    got = {r.id: r.oof_pred for r in oof_group_mean(df, "g", "y", "fold").collect()}
    for i, g, y, f in rows:
        others = [yy for _, gg, yy, ff in rows if gg == g and ff != f]
        assert got[i] == pytest.approx(sum(others) / len(others))


def test_search(spark, data):
    train, _ = data
    est = random_forest(seed=1)
    res = cross_validate(spark, est, build_grid(est, {"numTrees": [3, 6], "maxDepth": [2, 5]}), train, "fold", 3)
    ranked = rank_results(res).orderBy("rank").collect()
    assert len(ranked) == 4 and "maxDepth=5" in ranked[0].params
    maps = sample_grid(est, {"numTrees": [3, 6, 9], "maxDepth": [2, 5]}, 2, seed=1)
    assert len(maps) == 2 and maps == sample_grid(est, {"numTrees": [3, 6, 9], "maxDepth": [2, 5]}, 2, seed=1)


def test_search_fits_folds_alone(spark, data, monkeypatch):
    """The scores are CrossValidator's, of fits to the folds alone and to the columns that are named."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.tuning import CrossValidator
    train, _ = data
    est = DecisionTreeRegressor(seed=1)
    maps = build_grid(est, {"maxDepth": [1, 3]})
    want = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="mae"), numFolds=3,
                          foldCol="fold").fit(train).avgMetrics
    seen, fit = [], DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, df: seen.append(sorted(df.columns)) or fit(self, df))
    res = cross_validate(spark, est, maps, train.withColumn("wide", F.lit("x")), "fold", 3)
    assert seen == [["features", "fold", "label"]] * 6
    assert [r.mean_mae for r in res.collect()] == pytest.approx(want)
    with pytest.raises(ValueError):
        cross_validate(spark, est, maps, train, "fold", 2)


def test_explained_variance_search(spark, data):
    from ridecast.models.search import ExplainedVarianceEvaluator
    train, score = data
    m = random_forest(n_estimators=5, max_depth=5, seed=1).fit(train)
    scored = m.transform(score)
    rows = scored.select("label", "prediction").collect()
    y = np.array([r.label for r in rows])
    p = np.array([r.prediction for r in rows])
    assert ExplainedVarianceEvaluator().evaluate(scored) == pytest.approx(1 - np.var(y - p) / np.var(y))
    est = random_forest(seed=1)
    res = cross_validate(spark, est, build_grid(est, {"maxDepth": [1, 5]}), train, "fold", 3,
                         metric="explained_variance")
    best = rank_results(res, "mean_explained_variance", larger_is_better=True).orderBy("rank").first()
    assert "maxDepth=5" in best.params


def test_size_partitions_rule(spark):
    from ridecast.models.estimators import size_partitions
    wide = spark.range(0, 1000).repartition(50)
    assert size_partitions(wide, 1000, "id").rdd.getNumPartitions() == 4                 # a few tasks at least
    narrow = spark.range(0, 1000).coalesce(1)
    assert size_partitions(narrow, 1000, "id").rdd.getNumPartitions() == 4
    assert size_partitions(narrow, 1000, "id", rows_per_partition=100, min_partitions=1).rdd.getNumPartitions() == 10
