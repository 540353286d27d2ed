"""Frame counts, forward selection, sparse one-hot and dictionaries as frames against plain Python."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridecast.models.subset import forward_selection
from ridecast.operators.encode import CategoryCodes, SparseOneHot, one_hot
from ridecast.operators.frames import counts_in_frame


def test_counts_in_frame(spark):
    rng = random.Random(3)
    start = datetime.date(2017, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), start + datetime.timedelta(rng.randrange(40)), "x") for i in range(300)]
    rows.append((300, "a", None, "x"))
    df = spark.createDataFrame(rows, "id long, key string, day date, n string")
    got = {r.id: r.in_frame for r in counts_in_frame(df, "key", "day", 7).collect()}
    for i, key, day, _ in rows:
        want = None if day is None else sum(
            k == key and d is not None and day - datetime.timedelta(7) <= d < day for _, k, d, _ in rows)
        assert got[i] == want
    assert counts_in_frame(df.where("id < 0"), "key", "day", 7).count() == 0


def test_forward_selection_equals_all_fits(spark):
    rng = np.random.default_rng(5)
    n, names = 240, ["a", "b", "c", "d"]
    x = rng.normal(size=(n, 4))
    y = 3 * x[:, 2] - 2 * x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y))],
                               "a double, b double, c double, d double, y double, fold int")

    def error(chosen):
        out = 0.0
        for f in range(4):
            test = np.arange(n) % 4 == f
            design = np.c_[np.ones(n), x[:, chosen]]
            b = np.linalg.lstsq(design[~test], y[~test], rcond=None)[0]
            out += ((y - design @ b)[test] ** 2).sum()
        return out / n

    chosen, want = [], [(0, None, error([]))]
    while len(chosen) < 4:
        best = min((c for c in range(4) if c not in chosen), key=lambda c: error([*chosen, c]))
        if error([*chosen, best]) >= want[-1][2]:
            break
        chosen.append(best)
        want.append((len(chosen), names[best], error(chosen)))
    got = [tuple(r) for r in forward_selection(df, names, "y", "fold").orderBy("step").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 2
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert forward_selection(df.where("fold > 9"), names, "y", "fold").count() == 0


@pytest.mark.parametrize("size", [3, 1500])
def test_sparse_one_hot_and_frames(spark, size):
    train = spark.createDataFrame([(f"v{i:04d}", float(i % 2)) for i in range(size)] + [(None, None), ("v0001", float("nan"))],
                                  "v string, rest double")
    other = spark.createDataFrame([(1, "v0001", 1.0), (2, None, 0.0), (3, "unseen", None), (4, f"v{size - 1:04d}", 7.0)],
                                  "vector long, v string, rest double")
    hot = SparseOneHot(["v", "rest"]).fit(train)
    rows = {r.vector: r.features for r in hot.transform(other).collect()}
    assert hot.width == size + 2 and all(v.size == size + 2 for v in rows.values())
    assert {i: v.toArray().nonzero()[0].tolist() for i, v in rows.items()} == {1: [1, size + 1], 2: [size], 3: [], 4: [size - 1]}
    codes = CategoryCodes(["v", "rest"]).fit(train)
    assert [tuple(r) for r in codes.frame(spark, "v").orderBy("code").collect()] == [(f"v{i:04d}", i) for i in range(size)]
    if size > 1024:
        with pytest.raises(ValueError, match="SparseOneHot"):
            one_hot(train, "v")
    nothing = SparseOneHot(["v"]).fit(train.where(F.lit(False)))
    assert [r.features.toArray().nonzero()[0].tolist() for r in nothing.transform(other).collect()] == [[]] * 4
