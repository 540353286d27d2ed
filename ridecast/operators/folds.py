"""Hold-out splits and folds.

Cuts of an order (hold-outs, contiguous and stratified folds) are found by selection (``operators/select``): a few
aggregations of the key, then a comparison in the projection; no row is sorted or moved.  Rows of equal keys stay together.
``kfold_stratified`` numbers rows within labels and uses the distributed global rank.  ``hash_folds`` needs no order at all
and is the mode for the largest inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.operators.rank import global_rank
from ridecast.operators.select import at_least, rows_at


def shuffle_key(key: str, seed: int) -> Column:
    """A reproducible pseudo-random order: md5 of ``key|seed`` (no rand())."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _shuffled(key: str, seed: int) -> list[Column]:
    return [shuffle_key(key, seed), F.col(key)]


def _fold_number(order: list[Column], cuts: list[tuple]) -> Column:
    """How many cuts a row has passed."""
    return sum((at_least(order, c).cast("int") for c in cuts), F.lit(0))


def ntile_starts(rows: int, k: int) -> list[int]:
    """The first rank of each tile but the first, with sizes as SQL's ``ntile``: the first ``rows % k`` hold one more."""
    size, more = divmod(rows, k)
    return [i * size + min(i, more) for i in range(1, k)]


def holdout_split(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 1,
                  shuffle: bool = True, name: str = "is_test") -> DataFrame:
    """Mark the last ``ceil(n * test_size)`` rows of the (shuffled or key) order as test."""
    order = _shuffled(key, seed) if shuffle else [F.col(key)]
    cuts = rows_at(df, order, plan=lambda n: [n - math.ceil(n * test_size)]).get(None, [])
    return df.withColumn(name, at_least(order, cuts[0]).cast("int") if cuts else F.lit(0))


def kfold_ntile(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """K contiguous folds over the key order, sizes as SQL ``ntile`` (0-based fold ids)."""
    order = [F.col(key)]
    return df.withColumn(name, _fold_number(order, rows_at(df, order, plan=lambda n: ntile_starts(n, k)).get(None, [])))


def stratified_cuts(df: DataFrame, key: str, label: str, k: int, strata: int | list[float] = 10, seed: int = 0) -> dict:
    """Where the folds of shuffled, stratified folds begin.  ``strata`` are upper bounds of the label for all strata but
    the last, or a number of quantile classes.  The result is plain data: {"label": bounds, "cuts": [cuts per stratum]}."""
    if isinstance(strata, int):
        points = df.approxQuantile(label, [i / strata for i in range(1, strata)], 0.001) if strata > 1 else []
        strata = sorted(set(points))
    found = rows_at(df, _shuffled(key, seed), plan=lambda n: ntile_starts(n, k), group=_stratum(label, strata))
    return {"label": list(strata), "cuts": [[list(c) for c in found.get(i, [])] for i in range(len(strata) + 1)]}


def _stratum(label: str, bounds: list[float]) -> Column:
    """How many bounds the label exceeds (a null label: none)."""
    return sum((F.coalesce(F.col(label) > F.lit(b), F.lit(False)).cast("int") for b in bounds), F.lit(0))


def stratified_fold(key: str, label: str, cuts: dict, seed: int = 0) -> Column:
    """The fold of a row by ``stratified_cuts``."""
    order, stratum = _shuffled(key, seed), _stratum(label, cuts["label"])
    out = F.lit(0)
    for i, own in enumerate(cuts["cuts"]):
        out = F.when(stratum == i, _fold_number(order, [tuple(c) for c in own])).otherwise(out)
    return out


def kfold_stratified(df: DataFrame, key: str, label: str, k: int = 5, name: str = "fold") -> DataFrame:
    """Stratified folds: within each label value, rows in key order are dealt
    round-robin to folds (``(row_number() over (partition by label order by
    key) - 1) % k``).  Computed from one global rank over (label, key) minus
    each label's first rank, so a label holding most rows is still spread over
    all tasks (a window partitioned by label would put it in one)."""
    ranked = global_rank(df, [F.col(label), F.col(key)], name="_r")
    first = ranked.groupBy(label).agg(F.min("_r").alias("_r0"))       # one row per label value
    # one row per label value; Spark (AQE) broadcasts it when it is small
    out = ranked.join(first, ranked[label].eqNullSafe(first[label]), "left").drop(first[label])
    return out.withColumn(name, ((F.col("_r") - F.col("_r0")) % k).cast("int")).drop("_r", "_r0")


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 1, name: str = "fold") -> DataFrame:
    """Fold = pmod(xxhash64(key, seed), k): no ordering, no shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))
