"""Forward selection of features for a linear learner from sums that one pass gathers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_sums(df: DataFrame, features: list[str], label: str, fold: str) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, features, label): one aggregation, one row per fold.  Rows with a null in
    any of them are left out."""
    names = ["1", *features, label]
    cols = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in (*features, label)]]
    n = len(cols)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    rows = df.dropna(subset=[*features, label, fold]).groupBy(fold).agg(
        *[F.sum(cols[i] * cols[j]).alias(f"s_{i}_{j}") for i, j in at]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"s_{i}_{j}"]
        out[r[fold]] = m
    return out


def _error(sums: dict[int, np.ndarray], chosen: list[int], ridge: float) -> float:
    """Mean squared error over held-out folds of the least-squares fit to the other folds."""
    total = sum(sums.values())
    at = [0, *chosen]
    error = rows = 0.0
    for own in sums.values():
        rest = total - own
        gram = rest[np.ix_(at, at)] + ridge * np.diag([0.0] + [1.0] * len(chosen))
        b = np.linalg.lstsq(gram, rest[at, -1], rcond=None)[0]
        error += own[-1, -1] - 2 * b @ own[at, -1] + b @ own[np.ix_(at, at)] @ b
        rows += own[0, 0]
    return error / rows if rows else float("nan")


def forward_selection(df: DataFrame, features: list[str], label: str, fold: str, most: int | None = None,
                      ridge: float = 0.0) -> DataFrame:
    """(step, feature, cv_mse): the features in the order in which each, added to those before, lowers the cross-validated
    error of a linear fit the most (ties: the first in ``features``); it ends when none lowers it, or after ``most``.
    Step 0 has no feature: the mean.

    All candidate sets are scored from the same sums, which one pass gathers: steps and candidates cost no more passes."""
    sums = fold_sums(df, features, label, fold)
    rows, chosen, left = [], [], list(range(1, len(features) + 1))
    if sums:
        rows.append((0, None, float(_error(sums, [], ridge))))
    while sums and left and len(chosen) < (most or len(features)):
        scores = [_error(sums, [*chosen, c], ridge) for c in left]
        best = int(np.argmin(scores))
        if scores[best] >= rows[-1][2]:
            break
        chosen.append(left.pop(best))
        rows.append((len(chosen), features[chosen[-1] - 1], float(scores[best])))
    return df.sparkSession.createDataFrame(rows, "step int, feature string, cv_mse double")
