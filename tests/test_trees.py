"""Level-grown trees against brute force, their independence of the layout, boosting, AdaBoost, stacking and searches."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from ridecast.models.adaboost import AdaBoost
from ridecast.models.search import Search, build_grid, params_text
from ridecast.models.stacking import StackingModel, StackingTransformer
from ridecast.models.trees import LevelForest, SecondOrderBoosting, TreesModel, bin_edges

INPUTS = ["x0", "x1", "x2"]


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, label double")
    return VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep").transform(df)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(0, 6, 300), rng.integers(0, 4, 300), rng.integers(0, 9, 300)].astype(float)
    y = np.round(2 * x[:, 0] - x[:, 1] ** 2 + rng.integers(0, 5, 300))
    return frame(spark, x, y).persist(), x, y


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").select("prediction").collect()])


def brute(x, y, depth, cost, leaf, least=1):
    """The greedy tree over all cuts half-way between values, in plain numpy."""
    best = None
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= least:
                gain = cost(y) - cost(y[low]) - cost(y[~low])
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, cut
    if best is None or best[0] <= 1e-9:
        return np.full(len(y), leaf(y))
    low, out = x[:, best[1]] <= best[2], np.empty(len(y))
    for side in (low, ~low):
        out[side] = brute(x[side], y[side], depth - 1, cost, leaf, least)
    return out


@pytest.mark.parametrize("criterion, cost, leaf", [
    ("absolute", lambda v: np.abs(v - np.median(v)).sum(), np.median), ("squared", lambda v: ((v - v.mean()) ** 2).sum(), np.mean)])
def test_tree_equals_all_cuts(data, criterion, cost, leaf):
    df, x, y = data
    model = LevelForest(numTrees=1, bootstrap=False, maxDepth=2, criterion=criterion, minLeaf=5.0, keyCol="id").fit(df)
    assert np.allclose(predictions(model, df), brute(x, y, 2, cost, leaf, 5), atol=1e-7)


def test_forest_does_not_depend_on_the_layout(data):
    df, _, y = data
    forest = LevelForest(numTrees=6, maxDepth=4, criterion="absolute", maxFeatures=0.7, keyCol="id", seed=5)
    a, b = forest.fit(df), forest.fit(df.repartition(7).orderBy(F.rand(1)))
    assert a.to_rows() == b.to_rows() == TreesModel.from_rows(a.to_rows()).to_rows()
    assert np.abs(predictions(a, df) - y).mean() < 0.7 * np.abs(y - np.median(y)).mean()
    assert a.featureImportances.sum() == pytest.approx(1)


def test_extra_trees_draw_a_cut_per_tree_and_node(data):
    df, _, y = data
    model = LevelForest(numTrees=8, maxDepth=4, splitter="random", bootstrap=False, keyCol="id").fit(df)
    assert len({(t.feature[0], t.cut[0]) for t in model.trees}) > 1
    assert np.abs(predictions(model, df) - y).mean() < 0.6 * np.abs(y - y.mean()).mean()


def test_odd_rows(spark, data):
    """No rows, rows without a label, NaN features, null vectors, one value only, many values."""
    df, _, _ = data
    forest = LevelForest(numTrees=2, maxDepth=2, keyCol="id")
    assert set(predictions(forest.fit(df.where("id < 0")), df)) == {0.0}
    holes = df.withColumn("label", F.when(F.col("id") < 200, F.col("label")))
    same = LevelForest(numTrees=2, maxDepth=2, keyCol="id").fit(df.where("id < 200"))
    assert forest.fit(holes).to_rows() == same.to_rows()
    x = np.c_[np.where(np.arange(40) < 20, np.nan, 1.0), np.ones(40), np.ones(40)]
    nan = frame(spark, x, np.where(np.arange(40) < 20, 3.0, 7.0))
    tree = LevelForest(numTrees=1, bootstrap=False, maxDepth=1, keyCol="id").fit(nan)
    assert set(predictions(tree, nan)) == {5.0}         # one bin beside NaN: there is no cut to part them
    gone = df.limit(2).select("id", F.lit(None).cast(df.schema["features"].dataType).alias("features"))
    assert [r.prediction for r in same.transform(gone).collect()] == [None, None]
    many = spark.range(5000).select("id", F.col("id").cast("double").alias("v"))
    cuts, points = bin_edges(many, {"v": F.col("v")}, 16)["v"]
    assert len(points) == len(cuts) + 1 and 10 <= len(cuts) <= 16


def test_out_of_bag_leaves_drawn_trees_out(data):
    df, _, _ = data
    forest = LevelForest(numTrees=5, maxDepth=2, keyCol="id")
    drawn = df.withColumn("w", forest.sample(df)).persist()
    model = LevelForest(numTrees=5, maxDepth=2, keyCol="id", weightsArrayCol="w").fit(drawn)
    for r in model.out_of_bag(drawn, F.col("w")).limit(40).collect():
        x = np.array([r.features.toArray()])
        from ridecast.models.trees import Router
        left = [Router([t]).values(x, 0)[0] for t, w in zip(model.trees, r.w) if w == 0]
        assert r.oob_pred == (pytest.approx(np.mean(left)) if left else None)


def test_second_order_boosting(data):
    """Two rounds in numpy: regularised leaves, least child weight, and a column sample that all trees share by seed."""
    df, x, y = data
    model = SecondOrderBoosting(numRounds=2, stepSize=0.5, maxDepth=1, l2=2.0, minChildWeight=30.0, baseScore=1.0, keyCol="id").fit(df)
    f = np.full(len(y), 1.0)
    for _ in range(2):
        g, best = f - y, None
        score = lambda m: g[m].sum() ** 2 / (m.sum() + 2.0)                                        # noqa: E731
        for j in range(3):
            for cut in np.unique(x[:, j])[:-1] + 0.5:
                low = x[:, j] <= cut
                if min(low.sum(), (~low).sum()) >= 30:
                    gain = score(low) + score(~low) - score(low | True)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, low
        for side in (best[1], ~best[1]):
            f[side] += 0.5 * -g[side].sum() / (side.sum() + 2.0)
    assert np.allclose(predictions(model, df), f, atol=1e-6)
    narrow = SecondOrderBoosting(numRounds=14, maxDepth=2, columnSample=0.4, subsample=0.7, keyCol="id").fit(df)
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in narrow.trees)
    assert len({f for t in narrow.trees for f in t.feature if f >= 0}) > 1
    assert np.abs(predictions(narrow, df) - y).mean() < np.abs(0.5 - y).mean()


def test_adaboost_over_any_base(data):
    df, _, y = data
    base = np.abs(y - y.mean()).mean()
    for member in (LinearRegression(), LevelForest(numTrees=3, maxDepth=3, splitter="random"), DecisionTreeRegressor(maxDepth=3)):
        boost = AdaBoost(base=member, numRounds=3, learningRate=0.5, keyCol="id")
        model = boost.fit(df)
        assert 1 <= len(model.members) <= 3
        assert np.abs(predictions(model, df) - y).mean() < base
    again = boost.fit(df.repartition(5))
    assert np.allclose(predictions(again, df), predictions(model, df))
    # the vote: weighted median of the members
    votes = np.array([predictions(m.copy({m.getParam("featuresCol"): "features", m.getParam("predictionCol"): "prediction"}), df)
                      for m in model.members])
    order = np.argsort(votes, 0, kind="stable")
    run = np.cumsum(np.array(model.votes)[order], 0)
    pick = (run >= 0.5 * run[-1] - 1e-12).argmax(0)
    assert np.allclose(predictions(model, df), votes[order[pick, np.arange(len(y))], np.arange(len(y))])
    with pytest.raises(ValueError):
        boost.fit(df.where("id < 0"))


def test_search_keeps_its_winner_and_resumes(spark, data, tmp_path):
    df, _, _ = data
    train = df.withColumn("fold", (F.col("id") % 3).cast("int")).persist()
    boost = AdaBoost(numRounds=1, keyCol="id")
    maps = build_grid(boost, {"base": [LevelForest(numTrees=2, maxDepth=3, splitter="random"), LinearRegression(regParam=0.5)]})
    store = str(tmp_path / "scores")
    first = Search([("adaboost", boost, maps[:1])], k=3, store=store).fit(train)
    calls = []
    second = Search([("adaboost", boost, maps)], k=3, store=store)
    score, second._score = second._score, lambda *a: calls.append(a[2]) or score(*a)
    found = second.fit(train)
    assert len(calls) == 3 and all(c is maps[1] for c in calls)             # only the new candidate was scored
    assert {r[1]: r[2] for r in found.rows}[params_text(maps[0])] == first.best_score
    assert found.best_score == min(r[2] for r in found.rows)
    assert found.transform(train).where("prediction is null").isEmpty()


def test_stacking_transformer(spark, data, tmp_path):
    df, _, _ = data
    learners = {"et": LevelForest(numTrees=2, maxDepth=3, splitter="random", bootstrap=False, keyCol="id"),
                "line": LinearRegression()}
    model = StackingTransformer(learners, folds=3, strata=3, seed=1, key="id").fit(df)
    oof = model.transform_train(df)
    assert oof.count() == df.count() and set(oof.columns) == {*df.columns, "oof_et", "oof_line"}
    path = str(tmp_path / "stack")
    model.save(path)
    again = StackingModel.load(path)
    show = lambda d: sorted((r.id, r.oof_et, r.oof_line) for r in d.collect())                     # noqa: E731
    assert show(again.transform_train(df)) == show(oof)
    assert show(again.transform(df)) == show(model.transform(df)) != show(oof)


# --- rows of equal features and label are one row ---------------------------

def test_levels_read_different_rows_only(spark, monkeypatch):
    from ridecast.models import trees
    read, own = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda rows, *more: read.append(rows.count()) or own(rows, *more))
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 3, 4000), rng.integers(0, 2, 4000), np.zeros(4000)].astype(float)
    y = x[:, 0] + x[:, 1]
    df = frame(spark, x, y)
    for model in (LevelForest(numTrees=3, maxDepth=2, keyCol="id"), SecondOrderBoosting(numRounds=2, maxDepth=2, keyCol="id"),
                  SecondOrderBoosting(numRounds=2, maxDepth=2, subsample=0.5, keyCol="id")):
        fitted = model.fit(df)
        assert max(read) == 6                               # of 4000
        read.clear()
        assert fitted.trees[0].weight[0] > 1000


def test_merge_rows_sums(spark, monkeypatch):
    from ridecast.models import trees
    nan = float("nan")
    rows = [([0.0, nan], 1.0, [1, 0]), ([-0.0, nan], 1.0, [2, 5]), ([0.0, 2.0], 1.0, [40000, 1]), ([0.0, 2.0], 2.0, [0, 0])] * 50
    df = spark.createDataFrame(rows, "x array<double>, y double, w array<int>").repartition(3)
    for most in (1 << 22, 8):                               # also when tasks pass on what they hold at once
        monkeypatch.setattr(trees, "MERGED", most)
        got = {}
        for r in trees.merge_rows(df).collect():
            k = str(r.x), r.y
            n, w = got.get(k, (0, [0, 0]))
            got[k] = n + r.n, [a + b for a, b in zip(w, r.w)]
        assert got == {("[0.0, nan]", 1.0): (100, [150, 250]), ("[0.0, 2.0]", 1.0): (50, [2_000_000, 50]),
                       ("[0.0, 2.0]", 2.0): (50, [0, 0])}


def test_rows_carry_one_number_until_merged(data, monkeypatch):
    """Draws are made where rows are merged, the same as by column; extra trees have one weight for all trees."""
    from ridecast.models import trees
    df, _, _ = data
    seen, merge = [], trees.merge_rows

    def recorded(rows, *more):
        seen.append(rows.agg(F.max(F.size("w"))).first()[0])
        return merge(rows, *more)

    forest = LevelForest(numTrees=7, maxDepth=3, keyCol="id", seed=5)
    by_column = LevelForest(numTrees=7, maxDepth=3, keyCol="id", seed=5, weightsArrayCol="w").fit(df.withColumn("w", forest.sample(df)))
    monkeypatch.setattr(trees, "merge_rows", recorded)
    assert [t.__dict__ for t in forest.fit(df).trees] == [t.__dict__ for t in by_column.trees]
    extra = LevelForest(numTrees=7, maxDepth=3, keyCol="id", splitter="random", bootstrap=False, minDecrease=0.01).fit(df)
    assert seen == [1, 1] and {t.weight[0] for t in extra.trees} == {300}
    hashes = df.select(F.xxhash64(F.col("id").cast("string"), F.lit(5)).alias("h"), forest.sample(df).alias("w")).collect()
    assert trees.bootstrap_draws(7)(np.array([r.h for r in hashes])).tolist() == [list(r.w) for r in hashes]


def test_many_draws_of_one_row(spark):
    """More draws than 16 bits hold."""
    df = frame(spark, np.array([[0.0, 0, 0], [0.0, 0, 0]]), np.array([1.0, 4.0])).withColumn(
        "w", F.array(F.when(F.col("label") == 1, 50_000).otherwise(100_000)))
    model = LevelForest(numTrees=1, maxDepth=1, keyCol="id", weightsArrayCol="w").fit(df)
    assert model.trees[0].weight[0] == 150_000 and model.trees[0].value[0] == pytest.approx(3.0)


def test_quantile_cuts_count_repeated_rows(spark):
    rows = [(0.0, 900)] + [(float(i), 1) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "v double, n long")
    cuts, _ = bin_edges(df, {"v": F.col("v")}, 10, F.col("n"))["v"]
    plain, _ = bin_edges(df.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))),
                         {"v": F.col("v")}, 10)["v"]
    assert len(cuts) == len(plain) <= 3                     # nine of ten values are 0


def test_poisson_quantiles(spark):
    from ridecast.models.trees import poisson

    def plain(u, mean, most=200):
        n, p = 0, np.exp(-mean)
        c = p
        for i in range(1, most + 1):
            if c < u:
                n, p = n + 1, p * mean / i
                c += p
        return n

    rng = np.random.default_rng(2)
    rows = [(float(u), float(m)) for u, m in zip(rng.random(500), np.r_[rng.random(250) * 3, rng.random(240) * 100, [0.0] * 10])]
    df = spark.createDataFrame(rows, "u double, m double")
    made = df.select("u", "m", poisson(F.col("u"), F.col("m")).alias("n"))
    assert [r.n for r in made.collect()] == [plain(u, m) for u, m in rows]
    assert "sequence" not in made._jdf.queryExecution().toString()      # no 200 interpreted steps a row


def test_stacked_models_share_a_worker(spark, data):
    """Sums of several models run in one Python step, so that a task has one worker however many models there are."""
    df, x, y = data
    learners = {"a": LevelForest(numTrees=2, maxDepth=2, keyCol="id"), "b": LevelForest(numTrees=2, maxDepth=1, keyCol="id")}
    stacked = StackingTransformer(learners, folds=2, strata=1, key="id").fit(df)
    plan = stacked.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1


# --- few rows: whole trees in one task ---------------------------------------

def test_held_rows_grow_the_same_trees(data, monkeypatch):
    from ridecast.models import trees
    df, _, _ = data
    kinds = [dict(splitter="random", bootstrap=False, maxDepth=60), dict(maxDepth=4, maxFeatures=0.5, minSplit=9.0, minDecrease=0.001),
             dict(criterion="absolute", maxDepth=3), dict(splitter="random", criterion="absolute", maxDepth=3, maxFeatures=0.5)]
    for kind in kinds:
        forest, got = LevelForest(numTrees=3, keyCol="id", seed=4, **kind), []
        for held, cells in ((1 << 22, 1 << 20), (1 << 22, 1), (0, 1 << 20)):
            monkeypatch.setattr(trees, "HELD", held)
            monkeypatch.setattr(trees, "CELLS", cells)
            if held or kind["maxDepth"] < 60:
                got.append(forest.fit(df).to_rows())
        assert all(g == got[0] for g in got) and '"feature": [-1]' not in got[0][0]


def test_ridge_is_the_closed_form(spark):
    """With an intercept and without, which is kernel ridge with the linear kernel; weights count rows."""
    from ridecast.models.estimators import Ridge
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3)) + 2
    y, times = x @ [1.0, -2.0, 0.5] + 5 + rng.normal(size=40), rng.integers(1, 4, 40)
    df = frame(spark, x, y)
    weighted = spark.createDataFrame([(i, int(t)) for i, t in enumerate(times)], "id long, times int")
    df = df.withColumn("id", F.col("id").cast("long")).join(weighted, "id")
    xs, ys = np.repeat(x, times, 0), np.repeat(y, times)
    centred = xs - xs.mean(0)
    slopes = np.linalg.solve(centred.T @ centred + 3 * np.eye(3), centred.T @ (ys - ys.mean()))
    got = Ridge(alpha=3.0, weightCol="times").fit(df)
    assert got.coefficients.toArray() == pytest.approx(slopes) and got.intercept == pytest.approx(ys.mean() - xs.mean(0) @ slopes)
    dual = np.linalg.solve(xs @ xs.T + 3 * np.eye(len(xs)), ys)
    model = Ridge(alpha=3.0, fitIntercept=False, weightCol="times").fit(df)
    made = {r.id: r.prediction for r in model.transform(df).collect()}
    assert [made[i] for i in range(40)] == pytest.approx(x @ xs.T @ dual)


def test_boosting_queries_have_the_sources_sizes(monkeypatch):
    """Rounds, trees, depth, draws, grid and folds of the source's AdaBoost script."""
    from ridecast.plans import forecast

    class Stop(Exception):
        pass

    def stop(*args, **given):
        seen.append((args, given))
        raise Stop

    seen, folds = [], []
    monkeypatch.setattr(forecast, "prepared", lambda spark, d, folds=None: (folds_seen(folds), None))
    folds_seen = folds.append
    monkeypatch.setattr(forecast, "Search", stop)
    with pytest.raises(Stop):
        forecast.q_random_search(None, "")
    (_, _, maps), = seen.pop()[0][0]
    assert folds == [5] and len(maps) == 10
    values = {p.name: {str(m[p]) for m in maps} for p in maps[0]}
    assert values["numRounds"] <= {"2", "5", "8", "10", "20"} and len(values["base"]) == 3
    monkeypatch.setattr(forecast, "AdaBoost", stop)
    with pytest.raises(Stop):
        forecast.q_adaboost_r2(None, "")
    given = seen.pop()[1]
    base = {p.name: v for p, v in given["base"].extractParamMap().items()}
    assert given["numRounds"] == 8 and base["numTrees"] == 10 and base["maxDepth"] >= 60 and base["maxFeatures"] == 1.0


def test_stacked_learners_read_dealt_rows(spark, data, monkeypatch):
    """Rows are dealt to folds once, with the columns that learners name, not in each of their passes."""
    df, _, _ = data
    seen, fit = [], LevelForest._fit

    def recorded(self, rows):
        seen.append((set(rows.columns), rows._jdf.queryExecution().executedPlan().toString()))
        return fit(self, rows)

    monkeypatch.setattr(LevelForest, "_fit", recorded)
    StackingTransformer({"a": LevelForest(numTrees=1, maxDepth=1, keyCol="id")}, folds=2, strata=1, key="id").fit(
        df.withColumn("text", F.lit("not read by any learner")))
    assert len(seen) == 2 and all(c == {"features", "label", "id", "_fold"} and "InMemoryTableScan" in plan for c, plan in seen)
