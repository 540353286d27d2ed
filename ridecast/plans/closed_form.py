"""Model operators whose results have a closed form, so that SQL can check them.

The features are few and of few values: a tree of one level over a 0/1 feature is two group means (or medians), so forests,
bags, boosting, stacks, searches and AdaBoost over it come down to grouped aggregates.  The same estimators and functions run
on all ride features in ``forecast``.  Rides are ``orders``, the label is their number of ``lineitem`` rows; samples are drawn
by md5 of ride id and tree, which both engines have.
"""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.functions.mathx import half_even
from ridecast.models.adaboost import AdaBoost
from ridecast.models.ensemble import bag_predict, oof_predict, stack
from ridecast.models.estimators import (
    assemble, gradient_boosting_classifier, importance_table, linear_regression, random_forest,
)
from ridecast.models.search import Search, build_grid, cross_validate, rank_results, sample_grid
from ridecast.models.stacking import StackingTransformer
from ridecast.models.trees import LevelForest, SecondOrderBoosting
from ridecast.operators.folds import kfold_ntile
from ridecast.plans import bindings as B
from ridecast.plans.registry import query

#: Trees of the sampled ensembles.
TREES = 4

RIDES = f"""
    tickets AS (SELECT l_orderkey AS ride_id, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1),
    rides AS (
        SELECT o_orderkey AS ride_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent,
            substr(o_orderpriority, 1, 1)::DOUBLE AS priority, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open,
            n::DOUBLE AS y, o_orderdate < TIMESTAMP '{B.SCORE_FROM}' AS train
        FROM orders LEFT JOIN tickets ON o_orderkey = ride_id),
    t AS (SELECT * FROM rides WHERE train AND y IS NOT NULL),
    s AS (SELECT * FROM rides WHERE NOT train)"""

#: How often md5 of ``ride_id|tree`` draws a ride: 0, 1 or 2 times.
DRAWN = f"""
    draws AS (
        SELECT *, CASE WHEN h < 6 THEN 0 WHEN h < 12 THEN 1 ELSE 2 END AS m FROM (
            SELECT t.*, tree, strpos('0123456789abcdef', substr(md5(ride_id || '|' || tree), 1, 1)) - 1 AS h
            FROM t, range({TREES}) AS r(tree)))"""


def md5_draws() -> Column:
    """The same draws as an array column."""
    def one(t: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("ride_id").cast("string"), t.cast("string"))), 1, 1), 16, 10).cast("int")
        return F.when(h < 6, 0).when(h < 12, 1).otherwise(2).cast("short")

    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), one)


def plain_rides(spark: SparkSession, d: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(train, score) with a ``features`` vector of the named columns."""
    def made(df: DataFrame) -> DataFrame:
        return assemble(df.select(
            "*", F.when(F.col("travel_from").isin("1-URGENT", "2-HIGH"), 1.0).otherwise(0.0).alias("urgent"),
            F.substring("travel_from", 1, 1).cast("double").alias("priority"),
            F.when(F.col("car_type") == "O", 1.0).otherwise(0.0).alias("is_open")), features)

    train = made(B.train_rides(spark, d)).withColumn("label", F.col("number_of_tickets").cast("double"))
    return train.select("ride_id", "label", "features"), made(B.score_rides(spark, d)).select("ride_id", "features")


def _out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select("ride_id", *[F.round(c, digits).alias(c) for c in columns])


def one_level(**more) -> LevelForest:
    """One tree of one level without drawing: the group means of a 0/1 feature."""
    return LevelForest(**{"numTrees": 1, "maxDepth": 1, "bootstrap": False, "keyCol": "ride_id", **more})


def group_mean_tree(depth: int = 1) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(maxDepth=depth, labelCol="label", featuresCol="features", predictionCol="prediction")


@query("mae_forest", f"""
WITH {RIDES}, {DRAWN},
    sample AS (SELECT tree, priority, y FROM draws, unnest(range(m)) AS u(k)),
    cuts AS (SELECT DISTINCT tree, priority AS cut FROM sample),
    sides AS (
        SELECT tree, cut, priority <= cut AS low, median(y) AS mid FROM cuts JOIN sample USING (tree) GROUP BY ALL),
    costs AS (
        SELECT c.tree, cut, sum(abs(y - mid)) AS cost FROM sample AS c JOIN sides AS d ON c.tree = d.tree AND (priority <= cut) = low
        GROUP BY c.tree, cut HAVING count(DISTINCT low) = 2),
    best AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY tree ORDER BY cost, cut) = 1),
    leaves AS (SELECT s.ride_id, mid FROM s, best JOIN sides USING (tree, cut) WHERE (s.priority <= cut) = low)
SELECT ride_id, round(avg(mid), 6) AS prediction FROM leaves GROUP BY ride_id
""", covers=("EST-1", "ENS-1"))
def q_mae_forest(spark, d):
    """A forest that splits on the absolute error: per tree the cut of the priority with the least sum of deviations from
    the medians of both sides, over drawn rides."""
    train, score = plain_rides(spark, d, ["priority"])
    forest = LevelForest(numTrees=TREES, maxDepth=1, criterion="absolute", weightsArrayCol="draws", keyCol="ride_id")
    return _out(forest.fit(train.withColumn("draws", md5_draws())).transform(score), "prediction")


def _boost_sql(rounds: int, eta: float, l2: float, least: float) -> str:
    """Rounds of one-level second-order boosting over two 0/1 features; feature 0 is a tree without a split."""
    out = [f"{RIDES}, m0 AS (SELECT *, 0.5::DOUBLE AS f FROM t), p0 AS (SELECT *, 0.5::DOUBLE AS f FROM s)"]
    for r in range(rounds):
        out.append(f"""
    g{r} AS (
        SELECT * FROM (
            SELECT 0 AS feature, 0 AS v, sum(f - y) AS g, count(*) AS h FROM m{r}
            UNION ALL SELECT 1, urgent, sum(f - y), count(*) FROM m{r} GROUP BY ALL
            UNION ALL SELECT 2, is_open, sum(f - y), count(*) FROM m{r} GROUP BY ALL)),
    b{r} AS (
        SELECT feature, sum(g * g / (h + {l2})) - sum(g) ^ 2 / (sum(h) + {l2}) AS gain FROM g{r} GROUP BY feature
        HAVING feature = 0 OR count(*) = 2 AND min(h) >= {least} QUALIFY row_number() OVER (ORDER BY gain DESC, feature) = 1),
    w{r} AS (SELECT feature, v, -g / (h + {l2}) AS w FROM g{r} JOIN b{r} USING (feature)),
    m{r + 1} AS (
        SELECT m.* REPLACE (f + {eta} * w AS f) FROM m{r} AS m, w{r} WHERE v = CASE feature WHEN 0 THEN 0 WHEN 1 THEN urgent ELSE is_open END),
    p{r + 1} AS (
        SELECT p.* REPLACE (f + {eta} * w AS f) FROM p{r} AS p, w{r} WHERE v = CASE feature WHEN 0 THEN 0 WHEN 1 THEN urgent ELSE is_open END)""")
    return "WITH " + ",".join(out) + f"\nSELECT ride_id, round(f, 5) AS prediction FROM p{rounds}"


@query("second_order_boost", _boost_sql(3, 0.3, 1.0, 20), covers=("EST-3",))
def q_second_order_boost(spark, d):
    """Three rounds of second-order boosting, one level each, over two 0/1 features."""
    train, score = plain_rides(spark, d, ["urgent", "is_open"])
    model = SecondOrderBoosting(numRounds=3, stepSize=0.3, maxDepth=1, l2=1.0, minChildWeight=20.0, keyCol="ride_id").fit(train)
    return _out(model.transform(score), "prediction", digits=5)


GROUP_MEAN = f"""
WITH {RIDES}, leaves AS (SELECT urgent, avg(y) AS mean FROM t GROUP BY urgent)"""


@query("extra_trees_means", f"""{GROUP_MEAN}
SELECT ride_id, round(mean, 6) AS prediction FROM s JOIN leaves USING (urgent)
""", covers=("EST-9",))
def q_extra_trees_means(spark, d):
    """Extra trees, grown together: any cut drawn between 0 and 1 gives the group means."""
    train, score = plain_rides(spark, d, ["urgent"])
    model = one_level(numTrees=5, splitter="random").fit(train)
    return _out(model.transform(score), "prediction")


@query("out_of_bag", f"""
WITH {RIDES}, {DRAWN},
    leaves AS (SELECT tree, urgent, sum(m * y) / sum(m) AS mean FROM draws GROUP BY ALL),
    oob AS (
        SELECT ride_id, y, avg(mean) FILTER (m = 0) AS p FROM draws JOIN leaves USING (tree, urgent) GROUP BY ride_id, y)
SELECT round(avg(abs(y - p)), 6) AS oob_mae, count(p) AS n_oob, count(*) AS n FROM oob
""", covers=("ENS-5",))
def q_out_of_bag(spark, d):
    """Out-of-bag error of a forest whose trees grow in shared passes."""
    train, _ = plain_rides(spark, d, ["urgent"])
    train = train.withColumn("draws", md5_draws())
    forest = LevelForest(numTrees=TREES, maxDepth=1, weightsArrayCol="draws", keyCol="ride_id").fit(train)
    return forest.out_of_bag(train, F.col("draws")).agg(
        F.round(F.avg(F.abs(F.col("label") - F.col("oob_pred"))), 6).alias("oob_mae"), F.count("oob_pred").alias("n_oob"),
        F.count("*").alias("n"))


@query("importances", f"""
WITH {RIDES}, {DRAWN},
    sides AS (
        SELECT 'urgent' AS feature, tree, urgent AS v, sum(m * y) AS a, sum(m) AS b FROM draws GROUP BY ALL
        UNION ALL SELECT 'is_open', tree, is_open, sum(m * y), sum(m) FROM draws GROUP BY ALL),
    gains AS (
        SELECT feature, tree, sum(a * a / b) - sum(a) ^ 2 / sum(b) AS gain FROM sides GROUP BY ALL),
    shares AS (
        SELECT feature, tree, CASE WHEN row_number() OVER (PARTITION BY tree ORDER BY gain DESC, feature DESC) = 1
            THEN 1.0 ELSE 0.0 END AS share FROM gains)
SELECT feature, round_even(avg(share), 4) AS importance, round(stddev_pop(share), 6) AS std,
    row_number() OVER (ORDER BY avg(share) DESC, feature)::INT AS rank
FROM shares GROUP BY feature
""", covers=("EST-10", "AG-8", "ST-2", "ST-3", "MTH-3"))
def q_importances(spark, d):
    """Importances of a forest, their deviation over the trees, and ranks."""
    train, _ = plain_rides(spark, d, ["urgent", "is_open"])
    forest = LevelForest(numTrees=TREES, maxDepth=1, weightsArrayCol="draws", keyCol="ride_id")
    return importance_table(spark, forest.fit(train.withColumn("draws", md5_draws())), ["urgent", "is_open"])


def _adaboost_sql(rounds: int, rate: float) -> str:
    out = [f"{RIDES}, w0 AS (SELECT *, 1.0::DOUBLE AS w FROM t)"]
    for r in range(rounds):
        out.append(f"""
    l{r} AS (SELECT urgent, sum(w * y) / sum(w) AS p FROM w{r} GROUP BY urgent),
    e{r} AS (SELECT x.*, abs(p - y) AS e FROM w{r} AS x JOIN l{r} USING (urgent)),
    a{r} AS (SELECT max(e) AS top, sum(w * e) / max(e) / sum(w) AS loss FROM e{r}),
    w{r + 1} AS (
        SELECT e{r}.* EXCLUDE (e) REPLACE (w * pow(loss / (1 - loss), (1 - e / top) * {rate}) AS w) FROM e{r}, a{r})""")
    votes = " UNION ALL ".join(f"SELECT {r} AS r, urgent, p, {rate} * ln((1 - loss) / loss) AS v FROM l{r}, a{r}" for r in range(rounds))
    return "WITH " + ",".join(out) + f""",
    votes AS ({votes}),
    runs AS (SELECT *, sum(v) OVER (PARTITION BY urgent ORDER BY p, v, r) AS run, sum(v) OVER (PARTITION BY urgent) AS total FROM votes),
    mids AS (SELECT urgent, min_by(p, run) AS p FROM runs WHERE run >= total / 2 - 1e-12 GROUP BY urgent)
SELECT ride_id, round(p, 5) AS prediction FROM s JOIN mids USING (urgent)"""


@query("adaboost_tree", _adaboost_sql(3, 0.5), covers=("EST-8",))
def q_adaboost_tree(spark, d):
    """AdaBoost.R2 over a chosen base learner, weighted instead of drawn: three rounds of weighted group means."""
    train, score = plain_rides(spark, d, ["urgent"])
    model = AdaBoost(base=group_mean_tree(), numRounds=3, learningRate=0.5, resample=False, keyCol="ride_id").fit(train)
    return _out(model.transform(score), "prediction", digits=5)


FOLDS = """
    dealt AS (SELECT *, ntile(3) OVER (ORDER BY ride_id) - 1 AS fold FROM t),
    others AS (SELECT a.fold, b.urgent, b.y FROM (SELECT DISTINCT fold FROM dealt) AS a JOIN dealt AS b ON a.fold <> b.fold),
    fold_means AS (SELECT fold, urgent, avg(y) AS mean FROM others GROUP BY ALL),
    fold_all AS (SELECT fold, avg(y) AS whole FROM others GROUP BY fold),
    errors AS (
        SELECT fold, avg(abs(y - mean)) AS by_group, avg(abs(y - whole)) AS by_all
        FROM dealt JOIN fold_means USING (fold, urgent) JOIN fold_all USING (fold) GROUP BY fold)"""


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train, score = plain_rides(spark, d, ["urgent"])
    return kfold_ntile(train, "ride_id", k=3), score


@query("cv_scores", f"""
WITH {RIDES}, {FOLDS},
    scores AS (
        SELECT 'maxDepth=0' AS params, avg(by_all) AS mean_mae FROM errors
        UNION ALL SELECT 'maxDepth=1', avg(by_group) FROM errors)
SELECT 'tree' AS learner, params, round(mean_mae, 6) AS mean_mae, row_number() OVER (ORDER BY mean_mae, params)::INT AS rank FROM scores
""", covers=("SEL-1", "SEL-4"))
def q_cv_scores(spark, d):
    """Cross-validated error of a grid over tree depths (0: the mean of all rides)."""
    train, _ = _folded(spark, d)
    train = train.persist()
    tree = group_mean_tree()
    ranked = rank_results(cross_validate(spark, tree, build_grid(tree, {"maxDepth": [0, 1]}), train, "fold", 3, learner="tree"))
    train.unpersist()
    return ranked.withColumn("mean_mae", F.round("mean_mae", 6))


@query("search_forecast", f"""
WITH {RIDES}, {FOLDS},
    whole AS (SELECT avg(y) AS mean FROM t), leaves AS (SELECT urgent, avg(y) AS mean FROM t GROUP BY urgent),
    best AS (SELECT avg(by_group) AS g, avg(by_all) AS a FROM errors)
SELECT ride_id, round(CASE WHEN g < a THEN leaves.mean ELSE whole.mean END, 6) AS prediction, round(least(g, a), 6) AS cv_mae
FROM s JOIN leaves USING (urgent), whole, best
""", covers=("SEL-1", "SEL-4", "SEL-5"))
def q_search_forecast(spark, d):
    """The winner of a search, fitted to all rides, forecasts the rides to score."""
    train, score = _folded(spark, d)
    train = train.persist()
    tree = one_level()
    found = Search([("trees", tree, build_grid(tree, {"maxDepth": [0, 1]}))], k=3).fit(train)
    train.unpersist()
    return _out(found.transform(score).withColumn("cv_mae", F.lit(found.best_score)), "prediction", "cv_mae")


@query("search_base", f"""
WITH {RIDES}, {FOLDS},
    scores AS (
        SELECT 'base=DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=0, predictionCol=prediction), numRounds=1' AS params,
            avg(by_all) AS mean_mae FROM errors
        UNION ALL SELECT 'base=DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=1, predictionCol=prediction), numRounds=1',
            avg(by_group) FROM errors)
SELECT 'adaboost' AS learner, params, round(mean_mae, 6) AS mean_mae, row_number() OVER (ORDER BY mean_mae, params)::INT AS rank FROM scores
""", covers=("SEL-2", "SEL-3", "SEL-5"))
def q_search_base(spark, d):
    """A random search over the base learner that AdaBoost boosts; one round, so that scores have a closed form."""
    train, _ = _folded(spark, d)
    train = train.persist()
    boost = AdaBoost(numRounds=1, resample=False, keyCol="ride_id")
    grid = {"base": [group_mean_tree(0), group_mean_tree(1)], "numRounds": [1]}
    found = Search([("adaboost", boost, sample_grid(boost, grid, 2, seed=1))], k=3).fit(train)
    train.unpersist()
    return found.scores(spark).withColumn("mean_mae", F.round("mean_mae", 6))


STRATA = """
    dealt AS (
        SELECT *, ntile(5) OVER (PARTITION BY CASE WHEN y <= 2 THEN 0 WHEN y <= 4 THEN 1 ELSE 2 END
            ORDER BY md5(ride_id || '|0'), ride_id) - 1 AS fold FROM t),
    others AS (SELECT a.fold, b.urgent, b.is_open, b.y FROM (SELECT DISTINCT fold FROM dealt) AS a JOIN dealt AS b ON a.fold <> b.fold),
    by_urgent AS (SELECT fold, urgent, avg(y) AS u FROM others GROUP BY ALL),
    whole AS (SELECT fold, avg(y) AS w FROM others GROUP BY fold)"""


def _stacked(spark: SparkSession, d: str):
    train, score = plain_rides(spark, d, ["urgent"])
    learners = {"group": one_level(splitter="random"), "all": group_mean_tree(0)}
    train = train.persist()
    model = StackingTransformer(learners, folds=5, strata=[2.0, 4.0], seed=0).fit(train)
    train.unpersist()
    return model, train, score


@query("stack_folds", f"""
WITH {RIDES}, {STRATA}
SELECT ride_id, round(u, 6) AS oof_group, round(w, 6) AS oof_all FROM dealt JOIN by_urgent USING (fold, urgent) JOIN whole USING (fold)
""", covers=("ENS-2", "ENS-4", "SPL-4"))
def q_stack_folds(spark, d):
    """Out-of-fold predictions of a stacking transformer: shuffled folds within classes of the label."""
    model, train, _ = _stacked(spark, d)
    return _out(model.transform_train(train), "oof_group", "oof_all")


@query("stack_new_rides", f"""
WITH {RIDES}, {STRATA}
SELECT ride_id, round(avg(u), 6) AS oof_group, round(avg(w), 6) AS oof_all
FROM s JOIN by_urgent USING (urgent) JOIN whole USING (fold) GROUP BY ride_id
""", covers=("ENS-4",))
def q_stack_new_rides(spark, d):
    """The same transformer on the rides to score: means of the fold models."""
    model, _, score = _stacked(spark, d)
    return _out(model.transform(score), "oof_group", "oof_all")


@query("oof_predictions", f"""
WITH {RIDES}, {FOLDS}
SELECT ride_id, round(mean, 6) AS oof_tree, round(whole, 6) AS oof_all
FROM dealt JOIN fold_means USING (fold, urgent) JOIN fold_all USING (fold)
""", covers=("ENS-2",))
def q_oof_predictions(spark, d):
    """Out-of-fold predictions of two learners over given folds."""
    train, _ = _folded(spark, d)
    train = train.persist()
    oof, _ = oof_predict({"tree": group_mean_tree().fit, "all": group_mean_tree(0).fit}, train, "fold", 3)
    return _out(oof, "oof_tree", "oof_all")


@query("stack_line", f"""
WITH {RIDES}, {FOLDS},
    level2 AS (
        SELECT regr_slope(y, mean) AS b, regr_intercept(y, mean) AS a FROM dealt JOIN fold_means USING (fold, urgent)),
    scored AS (SELECT ride_id, avg(mean) AS p FROM s JOIN fold_means USING (urgent) GROUP BY ride_id)
SELECT ride_id, round(a + b * p, 4) AS prediction FROM scored, level2
""", covers=("ENS-3",))
def q_stack_line(spark, d):
    """A two-level stack: out-of-fold group means, then a line through them."""
    train, score = _folded(spark, d)
    train = train.persist()
    out = stack({"tree": group_mean_tree().fit}, lambda df: linear_regression().fit(df), train, score, "fold", 3, [], restack=False)
    return _out(out, "prediction", digits=4)


@query("bag_forecast", f"""{GROUP_MEAN}
SELECT ride_id, round(mean, 6) AS p_bag0, round(mean, 6) AS p_bag1, round(mean, 6) AS prediction,
    round_even(mean, 0) AS number_of_ticket
FROM s JOIN leaves USING (urgent)
""", covers=("ENS-1", "PRJ-13", "MTH-1"))
def q_bag_forecast(spark, d):
    """Two bags of an undrawn forest, averaged and rounded half to even, beside the ride's key."""
    train, score = plain_rides(spark, d, ["urgent"])
    train = train.persist()
    out = bag_predict(lambda seed: random_forest(n_estimators=1, max_depth=1, bootstrap=False, seed=seed), train, score,
                      seeds=[1, 2], keep_members=True)
    train.unpersist()
    return _out(out, "p_bag0", "p_bag1", "prediction").withColumn("number_of_ticket", half_even("prediction"))


@query("gbt_rounds", f"""{GROUP_MEAN}
SELECT ride_id, round(mean, 6) AS prediction FROM s JOIN leaves USING (urgent)
""", covers=("EST-2",))
def q_gbt_rounds(spark, d):
    """Boosting by the squared error over a 0/1 feature: the first tree leaves no group mean for the next ones."""
    train, score = plain_rides(spark, d, ["urgent"])
    return _out(GBTRegressor(maxIter=3, maxDepth=1, stepSize=0.5, seed=1).fit(train).transform(score), "prediction")


@query("gbt_absolute_rounds", f"""{GROUP_MEAN},
    steps AS (SELECT urgent, avg(CASE WHEN y - mean < 0 THEN -1.0 ELSE 1.0 END) AS step FROM t JOIN leaves USING (urgent) GROUP BY urgent)
SELECT ride_id, round(mean + 0.5 * step, 6) AS prediction FROM s JOIN leaves USING (urgent) JOIN steps USING (urgent)
""", covers=("EST-4",))
def q_gbt_absolute_rounds(spark, d):
    """Boosting by the absolute error: group means, then half the mean sign of what is left."""
    train, score = plain_rides(spark, d, ["urgent"])
    return _out(GBTRegressor(maxIter=2, maxDepth=1, stepSize=0.5, lossType="absolute", seed=1).fit(train).transform(score), "prediction")


@query("gbt_classes", f"""
WITH {RIDES},
    signs AS (SELECT *, CASE WHEN y >= 4 THEN 1.0 ELSE -1.0 END AS v FROM t),
    first AS (SELECT urgent, avg(v) AS f FROM signs GROUP BY urgent),
    second AS (
        SELECT urgent, avg(f) + 0.1 * avg(4 * v / (1 + exp(2 * v * f))) AS f FROM signs JOIN first USING (urgent) GROUP BY urgent)
SELECT ride_id, CASE WHEN f > 0 THEN 1 ELSE 0 END AS predicted_class, round(1 / (1 + exp(-2 * f)), 6) AS p_class1
FROM s JOIN second USING (urgent)
""", covers=("EST-5", "UDF-4"))
def q_gbt_classes(spark, d):
    """A boosted classifier of rides with four and more tickets, two rounds."""
    from pyspark.ml.functions import vector_to_array
    train, score = plain_rides(spark, d, ["urgent"])
    train = train.withColumn("y_class", (F.col("label") >= 4).cast("double"))
    out = gradient_boosting_classifier(n_estimators=2, max_depth=1, seed=1, label="y_class").fit(train).transform(score)
    return out.select("ride_id", F.col("prediction").cast("int").alias("predicted_class"),
                      F.round(vector_to_array("probability")[1], 6).alias("p_class1"))


@query("feature_vectors", f"""
WITH {RIDES}
SELECT ride_id, y AS label, [urgent::DOUBLE, priority, is_open::DOUBLE]::VARCHAR AS features FROM t
""", covers=("PRJ-9",))
def q_feature_vectors(spark, d):
    """Label and assembled features, apart; the vector as the text of its numbers."""
    from ridecast.models.estimators import features_as_array
    train, _ = plain_rides(spark, d, ["urgent", "priority", "is_open"])
    text = F.concat(F.lit("["), F.array_join(F.col("features").cast("array<string>"), ", "), F.lit("]"))
    return features_as_array(train).withColumn("features", text)
