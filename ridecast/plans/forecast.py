"""Model operators on the rides binding (orders = rides, tickets per order =
label): feature assembly, forests, boosting, AdaBoost, extra trees, bagging,
stacking, out-of-bag scoring and parameter search.

These have no SQL oracle (model fits on all ride features); the same estimators
and functions run in ``closed_form`` on features whose results SQL can check.
Here each is checked for schema, row count and error against a mean predictor.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridecast.functions.mathx import half_even, threshold_label
from ridecast.models.adaboost import AdaBoost
from ridecast.models.ensemble import bag_predict, stack
from ridecast.models.estimators import (
    Ridge, assemble, features_as_array, gradient_boosting, gradient_boosting_classifier, importance_table, linear_regression,
    random_forest, ridge, size_partitions,
)
from ridecast.models.search import Search, build_grid, cross_validate, rank_results, sample_grid
from ridecast.models.stacking import StackingTransformer
from ridecast.models.trees import DEEPEST, LevelForest, SecondOrderBoosting
from ridecast.operators.folds import holdout_split, kfold_ntile
from ridecast.plans import bindings as B
from ridecast.plans.registry import query
from ridecast.plans.rides import RideFeatures, RideSpec
from ridecast.session import cut_lineage
from ridecast.sources.tables import load

FEATURES = ["travel_date", "travel_from", "car_type", "month", "week", "is_weekend"]
LABEL = "number_of_tickets"


def ride_model_pipeline() -> RideFeatures:
    return RideFeatures(spec=RideSpec(travel_time=None), cutoff=B.TRAIN_CUTOFF, rare=B.RARE_PRIORITIES)


def prepared(spark: SparkSession, d: str, folds: int | None = None):
    """(train, score): assembled features; train carries ``label`` (and
    ``fold`` with ``folds``) and is persisted, being read by every fit."""
    rf = ride_model_pipeline()
    cached = B.train_rides(spark, d).persist()         # read by the dictionary fit and the feature pass
    rf.fit(cached)
    rows = cached.count()
    train = rf.transform(cached, train=True)
    score = rf.transform(B.score_rides(spark, d))
    train = assemble(train, FEATURES).withColumn("label", F.col(LABEL).cast("double"))
    if folds:
        train = kfold_ntile(train, "ride_id", k=folds)
    train = size_partitions(train, rows, "ride_id").persist()      # last step before caching: folds re-read a table
    train.count()                                        # fill the cache, then drop the ride cache
    cached.unpersist()
    return train, assemble(score, FEATURES)


def _r6(c):
    return F.round(c, 6)


@query("assemble", covers=("PRJ-9",))
def q_assemble(spark, d):
    train, _ = prepared(spark, d)
    out = cut_lineage(features_as_array(train.select("ride_id", "label", "features")))
    train.unpersist()
    return out


@query("rf_forecast", covers=("EST-1", "ENS-1", "PRJ-13", "MTH-1", "SNK-1"))
def q_rf_forecast(spark, d):
    """Bagged forest forecast of tickets per ride, rounded half-to-even,
    as (ride_id, number_of_ticket)."""
    train, score = prepared(spark, d)
    est = lambda s: random_forest(n_estimators=20, max_depth=8, min_samples_leaf=1,
                                  min_impurity_decrease=0.0005, seed=s)
    pred = bag_predict(est, train, score, seeds=[1, 2])
    train.unpersist()                                    # models fitted; output reads score only
    return pred.select("ride_id", half_even("prediction").alias("number_of_ticket"))


@query("bag_average", covers=("ENS-1",))
def q_bag_average(spark, d):
    train, score = prepared(spark, d)
    est = lambda s: random_forest(n_estimators=10, max_depth=6, seed=s)
    pred = bag_predict(est, train, score, seeds=[1, 2, 3], keep_members=True)
    train.unpersist()                                    # models fitted; output reads score only
    return pred.select("ride_id", *[_r6(F.col(c)).alias(c) for c in ("p_bag0", "p_bag1", "p_bag2", "prediction")])


@query("gbt_forecast", covers=("EST-2",))
def q_gbt_forecast(spark, d):
    train, score = prepared(spark, d)
    m = gradient_boosting(n_estimators=20, learning_rate=0.1, max_depth=5, subsample=0.5, seed=1).fit(train)
    train.unpersist()                                    # models fitted; output reads score only
    return m.transform(score).select("ride_id", "actual", _r6(F.col("prediction")).alias("prediction"))


@query("gbt_mae_forecast", covers=("EST-4",))
def q_gbt_mae_forecast(spark, d):
    train, score = prepared(spark, d)
    m = gradient_boosting(n_estimators=20, learning_rate=0.5, max_depth=5, loss="absolute", seed=1).fit(train)
    train.unpersist()                                    # models fitted; output reads score only
    return m.transform(score).select("ride_id", "actual", _r6(F.col("prediction")).alias("prediction"))


@query("gbt_classify", covers=("EST-5", "UDF-4"))
def q_gbt_classify(spark, d):
    train, score = prepared(spark, d)
    train = train.withColumn("y_class", threshold_label(LABEL, 4).cast("double"))
    m = gradient_boosting_classifier(n_estimators=10, max_depth=4, seed=1, label="y_class").fit(train)
    train.unpersist()
    from pyspark.ml.functions import vector_to_array
    out = m.transform(score)
    return out.select("ride_id", F.col("prediction").cast("int").alias("predicted_class"),
                      _r6(vector_to_array("probability")[1]).alias("p_class1"))


@query("linreg_coeffs", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL
""", covers=("EST-6",))
def q_linreg_coeffs(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice").dropna()
    data = assemble(li, ["l_quantity"]).withColumnRenamed("l_extendedprice", "label")
    m = linear_regression().fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "slope double, intercept double")


@query("ridge_coeffs", """
WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS cxy, var_pop(l_quantity) AS vx, count(*) AS n,
                  avg(l_quantity) AS mx, avg(l_extendedprice) AS my
           FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT round(cxy / (vx + 1.0 / n), 4) AS slope, round(my - cxy / (vx + 1.0 / n) * mx, 4) AS intercept FROM s
""", covers=("EST-7",))
def q_ridge_coeffs(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice").dropna()
    data = assemble(li, ["l_quantity"]).withColumnRenamed("l_extendedprice", "label").persist()
    m = ridge(data, alpha=1.0).fit(data)
    data.unpersist()
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "slope double, intercept double")


def mae_forest(seed: int = 1, trees: int = 100) -> LevelForest:
    """The source's main model: absolute error, depth 10, nine rows to split, a least decrease of 0.0005."""
    return LevelForest(numTrees=trees, criterion="absolute", maxDepth=10, minSplit=9.0, minDecrease=0.0005, seed=seed,
                       keyCol="ride_id")


@query("mae_forest_forecast", covers=("EST-1", "ENS-1", "PRJ-13", "MTH-1"))
def q_mae_forest_forecast(spark, d):
    """The forecast of the absolute-error forest on all ride features, rounded half to even."""
    train, score = prepared(spark, d)
    model = mae_forest().fit(train)
    train.unpersist()
    return model.transform(score).select("ride_id", half_even("prediction").alias("number_of_ticket"))


@query("second_order_forecast", covers=("EST-3",))
def q_second_order_forecast(spark, d):
    """Second-order boosting with row and column samples and a least child weight, on all ride features."""
    train, score = prepared(spark, d)
    model = SecondOrderBoosting(numRounds=6, stepSize=0.3, maxDepth=4, minChildWeight=4.0, subsample=0.8, columnSample=0.8,
                                seed=1, keyCol="ride_id").fit(train)
    train.unpersist()
    return model.transform(score).select("ride_id", _r6(F.col("prediction")).alias("prediction"))


@query("adaboost_r2", covers=("EST-8",))
def q_adaboost_r2(spark, d):
    """AdaBoost.R2 over extra trees, rows drawn by their weights: the source's eight rounds."""
    train, score = prepared(spark, d)
    model = AdaBoost(base=whole_extra_trees(), numRounds=8, learningRate=0.05, keyCol="ride_id").fit(train)
    train.unpersist()                                    # models fitted; output reads score only
    return model.transform(score).select("ride_id", _r6(F.col("prediction")).alias("prediction"))


def extra_trees(trees: int, depth: int, criterion: str = "squared") -> LevelForest:
    return LevelForest(numTrees=trees, maxDepth=depth, criterion=criterion, splitter="random", bootstrap=False, maxFeatures=0.5,
                       keyCol="ride_id")


def whole_extra_trees() -> LevelForest:
    """``ExtraTreesRegressor()`` as the source's sklearn has it: ten trees, all features at every node, grown until nodes are pure."""
    return LevelForest(numTrees=10, maxDepth=DEEPEST, splitter="random", bootstrap=False, keyCol="ride_id")


@query("extra_trees", covers=("EST-9",))
def q_extra_trees(spark, d):
    """120 extra trees by the absolute error, grown together."""
    train, score = prepared(spark, d)
    model = extra_trees(120, 10, "absolute").fit(train)
    train.unpersist()                                    # models fitted; output reads score only
    return model.transform(score).select("ride_id", _r6(F.col("prediction")).alias("prediction"))


@query("importance_table", covers=("EST-10", "AG-8", "ST-2", "ST-3", "MTH-3"))
def q_importance_table(spark, d):
    train, _ = prepared(spark, d)
    m = random_forest(n_estimators=20, max_depth=8, seed=1).fit(train)
    train.unpersist()
    return importance_table(spark, m, FEATURES)


def _rf_fit(n, depth, seed=1):
    return lambda df: random_forest(n_estimators=n, max_depth=depth, seed=seed).fit(df)


def _gbt_fit(n, depth, seed=1):
    return lambda df: gradient_boosting(n_estimators=n, max_depth=depth, learning_rate=0.1, subsample=0.5,
                                        seed=seed).fit(df)


@query("stack_two_level", covers=("ENS-3",))
def q_stack_two_level(spark, d):
    """Level 1: boosted trees and a forest, 5 folds; level 2: a forest on the
    out-of-fold predictions plus the raw features (restacking); scoring uses
    the mean of the fold models."""
    train, score = prepared(spark, d, folds=5)
    pred = stack({"gbt": _gbt_fit(10, 4), "rf": _rf_fit(10, 6)},
                 lambda df: random_forest(n_estimators=10, max_depth=6, seed=1).fit(df),
                 train, score, "fold", 5, FEATURES, restack=True)
    train.unpersist()                                    # all levels fitted; output reads score only
    return pred.select("ride_id", _r6(F.col("prediction")).alias("prediction"))


@query("stack_transform", covers=("ENS-4",))
def q_stack_transform(spark, d):
    """Extra trees, a forest and boosted trees under a stacking transformer with shuffled, stratified folds, and boosted
    trees on their out-of-fold predictions."""
    train, score = prepared(spark, d)
    learners = {"et": extra_trees(20, 4), "rf": random_forest(n_estimators=10, max_depth=6, seed=1),
                "gbt": gradient_boosting(n_estimators=10, max_depth=4, subsample=0.5, seed=1)}
    stacked = StackingTransformer(learners, folds=5, strata=5, seed=0, key="ride_id").fit(train)
    names = [f"oof_{n}" for n in learners]
    level2 = assemble(stacked.transform_train(train).drop("features"), names).persist()
    model = gradient_boosting(n_estimators=10, max_depth=3, seed=1).fit(level2)
    level2.unpersist()
    train.unpersist()
    out = model.transform(assemble(stacked.transform(score).drop("features"), names))
    return out.select("ride_id", _r6(F.col("prediction")).alias("prediction"))


@query("oob_mae", covers=("ENS-5",))
def q_oob_mae(spark, d):
    """Out-of-bag error of the absolute-error forest: each ride is judged by the trees that did not draw it."""
    train, _ = prepared(spark, d)
    forest = mae_forest(trees=20)
    oob = forest.fit(train).out_of_bag(train, forest.sample(train))
    out = cut_lineage(oob.agg(_r6(F.avg(F.abs(F.col("label") - F.col("oob_pred")))).alias("oob_mae"),
                              F.count("oob_pred").alias("n_oob"), F.count(F.lit(1)).alias("n")))
    train.unpersist()
    return out


@query("rf_holdout", covers=("SPL-1", "MET-1"))
def q_rf_holdout(spark, d):
    """Hold-out MAE of a forest on rounded predictions next to the
    predict-the-training-mean baseline."""
    train, _ = prepared(spark, d)
    split = holdout_split(train, "ride_id", test_size=0.3, seed=1).persist()
    fit_part, test_part = split.where("is_test = 0"), split.where("is_test = 1")
    m = random_forest(n_estimators=20, max_depth=8, seed=1).fit(fit_part)
    mean = fit_part.agg(F.avg("label").alias("_mean"))
    scored = m.transform(test_part).crossJoin(F.broadcast(mean))
    out = cut_lineage(scored.agg(_r6(F.avg(F.abs(F.col("label") - half_even("prediction")))).alias("mae"),
                                 _r6(F.avg(F.abs(F.col("label") - F.col("_mean")))).alias("baseline_mae"),
                                 F.count(F.lit(1)).alias("n")))
    split.unpersist()
    train.unpersist()
    return out


@query("grid_search", covers=("SEL-1", "SEL-5"))
def q_grid_search(spark, d):
    train, _ = prepared(spark, d, folds=3)
    est = random_forest(seed=1)
    maps = build_grid(est, {"numTrees": [10, 20], "maxDepth": [4, 8]})
    res = cross_validate(spark, est, maps, train, "fold", 3, learner="random_forest", parallelism=4)
    train.unpersist()
    return rank_results(res).withColumn("mean_mae", _r6(F.col("mean_mae")))


@query("random_search", covers=("SEL-2", "SEL-3", "SEL-5"))
def q_random_search(spark, d):
    """The source's random search: ten draws of the base learner that AdaBoost boosts (extra trees, ridge or kernel ridge), its
    rounds and rate, five folds."""
    train, _ = prepared(spark, d, folds=5)
    boost = AdaBoost(keyCol="ride_id")
    grid = {"base": [whole_extra_trees(), Ridge(), Ridge(fitIntercept=False)], "numRounds": [2, 5, 8, 10, 20],
            "learningRate": [0.05, 0.2, 0.5]}
    found = Search([("adaboost", boost, sample_grid(boost, grid, 10, seed=1))], k=5).fit(train)
    train.unpersist()
    return found.scores(spark).withColumn("mean_mae", _r6(F.col("mean_mae")))


@query("search_winner", covers=("SEL-1", "SEL-5"))
def q_search_winner(spark, d):
    """The forecast of a search's winner over two kinds of trees, fitted once to all rides."""
    train, score = prepared(spark, d, folds=3)
    forest, boost = extra_trees(10, 4), SecondOrderBoosting(numRounds=3, stepSize=0.5, maxDepth=2, keyCol="ride_id")
    found = Search([("extra_trees", forest, build_grid(forest, {"maxDepth": [2, 4]})),
                    ("boosting", boost, build_grid(boost, {"minChildWeight": [1.0]}))], k=3).fit(train)
    train.unpersist()
    return found.transform(score).select("ride_id", F.lit(found.best_learner).alias("learner"),
                                         _r6(F.col("prediction")).alias("prediction"))


@query("random_search_ev", covers=("SEL-2", "MET-4"))
def q_random_search_ev(spark, d):
    """Random search of the forest scored by cross-validated explained variance
    (larger is better)."""
    train, _ = prepared(spark, d, folds=3)
    rf = random_forest(seed=1)
    maps = sample_grid(rf, {"numTrees": [10, 20, 40], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 10]},
                       3, seed=2)
    res = cross_validate(spark, rf, maps, train, "fold", 3, learner="random_forest", parallelism=4,
                         metric="explained_variance")
    train.unpersist()
    ranked = rank_results(res, "mean_explained_variance", larger_is_better=True)
    return ranked.withColumn("mean_explained_variance", _r6(F.col("mean_explained_variance")))


@query("ride_forecast", covers=("UDF-6", "EST-1", "ENS-1", "PRJ-13", "MTH-1"))
def q_ride_forecast(spark, d):
    """The whole ticket-file flow on the ticket binding: tickets shipped before
    the scoring date train (counted per ride, dictionaries from the ticket
    columns), the distinct rides shipped on/after it are forecast by a bagged
    forest and rounded half-to-even."""
    from ridecast.plans.flows import forecast
    t = B.tickets(spark, d)
    cut = F.lit(B.SCORE_FROM).cast("timestamp_ntz")
    train_tickets = t.where(F.col("travel_date") < cut)
    to_score = t.where(F.col("travel_date") >= cut).dropDuplicates(["ride_id", "travel_date", "travel_from",
                                                                   "car_type"])
    return forecast(train_tickets, to_score, spec=RideSpec(travel_time=None), cutoff=B.TRAIN_CUTOFF,
                    rare=B.RARE_ORIGINS, bags=2, n_estimators=10, max_depth=6)
