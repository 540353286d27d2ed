"""Error metrics as aggregations (one row, or one row per group).

All are single-pass partial/final aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _g(df: DataFrame, by):
    return df.groupBy(*by) if by else df.groupBy()


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by=(), round_pred: bool = False,
                       with_rounded: bool = False) -> DataFrame:
    """MAE, RMSE, sqrt(MAE), explained variance (1 - var_pop(y-p)/var_pop(y)) and R^2.
    With ``round_pred`` the prediction is rounded half-to-even first; with
    ``with_rounded`` the MAE of the rounded prediction is added (same pass).
    ``n`` counts the rows that every metric is over: both label and prediction
    are there; ``n_rows`` counts all rows."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    pred = F.bround(F.col(p), 0) if round_pred else F.col(p)
    label = F.when(both, F.col(y))
    err = label - pred
    a = _g(df, by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sqrt(F.avg(F.abs(err))).alias("sqrt_mae"),
        F.var_pop(err).alias("_ve"), F.var_pop(label).alias("_vy"),
        F.sum(err * err).alias("_sse"), (F.var_pop(label) * F.count(label)).alias("_sst"),
        F.count(label).alias("n"), F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(label - F.bround(F.col(p), 0))).alias("mae_rounded"),
    )
    # constant y: explained variance and R^2 are 1 for a perfect fit and 0 otherwise
    ev = F.when(F.col("_vy") == 0, F.when(F.col("_ve") == 0, 1.0).otherwise(0.0)) \
        .otherwise(1 - F.col("_ve") / F.col("_vy"))
    r2 = F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)) \
        .otherwise(1 - F.col("_sse") / F.col("_sst"))
    extra = ["mae_rounded"] if with_rounded else []
    return a.select(*by, "mae", *extra, "rmse", "sqrt_mae", ev.alias("explained_variance"), r2.alias("r2"), "n", "n_rows")


def mae(df: DataFrame, y: str = "y", p: str = "p", round_pred: bool = False) -> float:
    pred = F.bround(F.col(p), 0) if round_pred else F.col(p)
    return df.agg(F.avg(F.abs(F.col(y) - pred))).first()[0]


def cv_mean_score(df: DataFrame, y: str = "y", p: str = "p", fold: str = "fold") -> DataFrame:
    """Mean over folds of the per-fold MAE (sum of scores / number of folds)."""
    per_fold = df.groupBy(fold).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("fold_mae"))
    return per_fold.agg(F.avg("fold_mae").alias("cv_mae"), F.count(F.lit(1)).alias("folds"))


def class_metrics(df: DataFrame, y: str = "y", p: str = "p", prob: str | None = None) -> DataFrame:
    """Accuracy and, with ``prob`` = probability of the true class, log loss."""
    aggs = [F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    if prob:
        eps = 1e-15
        pr = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
        aggs.append((-F.avg(F.log(pr))).alias("log_loss"))
    return df.agg(*aggs)


def confusion_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
