"""Ensembles: seed bagging, out-of-fold predictions and two-level stacking.  Predictions are columns of one keyed DataFrame; models are
combined by expressions and key joins, never by position."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oof_group_mean(df: DataFrame, group: str, y: str, fold: str, out: str = "oof_pred") -> DataFrame:
    """Out-of-fold prediction of the group-mean learner in one pass: the mean of
    ``y`` over rows of the same group in the other folds, from per-(group, fold)
    sums (partial aggregation; the table holds one row per group and fold, is
    materialized, counted and broadcast when within the limit).  A null group is a group."""
    from ridecast.operators.joins import bounded_broadcast
    gf = df.groupBy(group, fold).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_c"))
    gf, small = bounded_broadcast(gf)
    gt = gf.groupBy(group).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    gt = F.broadcast(gt) if small else gt
    gf, gt = gf.withColumnsRenamed({group: "_g", fold: "_f"}), gt.withColumnsRenamed({group: "_h"})
    j = (df.join(gf, F.col(group).eqNullSafe(F.col("_g")) & F.col(fold).eqNullSafe(F.col("_f")))
         .join(gt, F.col(group).eqNullSafe(F.col("_h"))).drop("_g", "_f", "_h"))
    rest = F.col("_tc") - F.col("_c")
    pred = F.when(rest > 0, (F.col("_ts") - F.col("_s")) / rest)
    return j.withColumn(out, pred).drop("_s", "_c", "_ts", "_tc")


def fit_all(fits: list, parallelism: int = 4) -> list:
    """Run independent fits (zero-argument callables) concurrently from driver
    threads; each fit is itself a distributed Spark job, the threads only keep
    the cluster busy between a fit's small jobs (as CrossValidator does)."""
    if parallelism <= 1 or len(fits) <= 1:
        return [f() for f in fits]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(fits))) as pool:
        return list(pool.map(lambda f: f(), fits))


def bag_predict(make_estimator, train: DataFrame, score: DataFrame, seeds: list[int], out: str = "prediction",
                keep_members: bool = False, parallelism: int = 4) -> DataFrame:
    """Fit one model per seed on ``train`` and average their predictions on
    ``score``.  The member predictions are chained transforms of the same
    frame (one pass, no joins); the mean is a column expression."""
    models = fit_all([lambda s=seed: make_estimator(s).fit(train) for seed in seeds], parallelism)
    members = []
    scored = score
    for i, model in enumerate(models):
        col = f"p_bag{i}"
        scored = model.setPredictionCol(col).transform(scored)
        members.append(col)
    mean = sum((F.col(c) for c in members), F.lit(0.0)) / len(members)
    scored = scored.withColumn(out, mean)
    return scored if keep_members else scored.drop(*members)


# ---------------------------------------------------------------------------
# out-of-fold predictions and stacking
# ---------------------------------------------------------------------------

def _apply(model, df: DataFrame, col: str) -> DataFrame:
    if hasattr(model, "setPredictionCol"):
        return model.setPredictionCol(col).transform(df)
    model.prediction = col
    return model.transform(df)


def oof_predict(learners: dict, df: DataFrame, fold: str, k: int, score: DataFrame | None = None,
                features: str = "features", parallelism: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions of every learner in ``learners`` (name -> fit
    function taking a training frame and returning a model).

    For fold i all learners are fitted on the other folds (the K x J fits run
    concurrently) and applied to fold i; the K fold blocks are unioned, so
    every row keeps its own key and features (no positional concatenation).
    With ``score``, each learner's prediction there is the mean of its K fold
    models (no refit on all rows)."""
    names = list(learners)
    jobs = [(i, name) for i in range(k) for name in names]
    models = fit_all([lambda i=i, name=name: learners[name](df.where(F.col(fold) != i)) for i, name in jobs],
                     parallelism)
    fitted = dict(zip(jobs, models))
    blocks = []
    score_out = score
    for i in range(k):
        block = df.where(F.col(fold) == i)
        for name in names:
            block = _apply(fitted[(i, name)], block, f"oof_{name}")
            if score_out is not None:
                score_out = _apply(fitted[(i, name)], score_out, f"_f{i}_{name}")
        blocks.append(block)
    oof = reduce(lambda a, b: a.unionByName(b), blocks)
    if score_out is not None:
        for name in names:
            cols = [f"_f{i}_{name}" for i in range(k)]
            score_out = score_out.withColumn(f"oof_{name}", sum((F.col(c) for c in cols), F.lit(0.0)) / k) \
                .drop(*cols)
    return oof, score_out


def stack(level1: dict, level2_fit, train: DataFrame, score: DataFrame, fold: str, k: int,
          raw_features: list[str], restack: bool = True, out: str = "prediction") -> DataFrame:
    """Two-level stack.  Level 1: out-of-fold predictions on train, fold-model
    means on the scoring set.  Level 2 is fitted on the level-1 columns, plus
    the raw features when ``restack`` is set, and applied to the scoring set."""
    from ridecast.models.estimators import assemble
    oof, s = oof_predict(level1, train, fold, k, score)
    meta = [f"oof_{n}" for n in level1] + (list(raw_features) if restack else [])
    l2_train = assemble(oof.drop("features"), meta, "features")
    l2_score = assemble(s.drop("features"), meta, "features")
    model = level2_fit(l2_train)
    return _apply(model, l2_score, out)
