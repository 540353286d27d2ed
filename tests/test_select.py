"""Selection of ranks and the folds that it cuts, against sorting in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ridecast.operators import select
from ridecast.operators.folds import holdout_split, kfold_ntile, ntile_starts, stratified_cuts, stratified_fold


@pytest.mark.parametrize("few", [3, 1000])
@pytest.mark.parametrize("kind, values", [
    ("long", [random.Random(1).randint(-10 ** 18, 10 ** 18) for _ in range(500)] + [-(1 << 63) + 1, (1 << 63) - 1]),
    ("long", [5] * 300 + list(range(200)) + [None] * 20),
    ("string", [f"key{random.Random(i).randint(0, 10 ** 6)}" for i in range(400)] + ["", "éa", None, "key", "key"]),
    ("double", [random.Random(i).gauss(0, 1) for i in range(300)] + [1e300, -1e300, 0.5, 0.5]),
    ("long", [7]), ("long", [])])
def test_rows_at_equals_sorting(spark, monkeypatch, few, kind, values):
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "BUCKETS", 8)
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 1, len(values)]
    got = select.rows_at(df, [F.col("v")], {None: ranks}).get(None, [])
    in_order = sorted(values, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v))
    assert [k[0] for k in got] == [in_order[r] for r in ranks if 0 <= r < len(values)]


def test_folds_equal_sorting(spark):
    ids = random.Random(4).sample(range(10 ** 6), 997)
    df = spark.createDataFrame([(i, float(i % 13)) for i in ids], "id long, y double")
    order = sorted(ids)
    size = [0, *ntile_starts(997, 5), 997]
    want = {i: next(f for f in range(5) if size[f] <= r < size[f + 1]) for r, i in enumerate(order)}
    assert {r.id: r.fold for r in kfold_ntile(df, "id", 5).collect()} == want
    shuffled = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|3".encode()).hexdigest(), i))
    test = set(shuffled[-250:])
    assert {r.id for r in holdout_split(df, "id", 0.25, seed=3).where("is_test = 1").collect()} == test
    cuts = stratified_cuts(df, "id", "y", 4, strata=[3.0, 8.0], seed=2)
    folds = {r.id: r.f for r in df.select("id", stratified_fold("id", "y", cuts, 2).alias("f")).collect()}
    for low, high in ((-1, 3), (3, 8), (8, 99)):
        part = sorted((i for i in ids if low < i % 13 <= high), key=lambda i: hashlib.md5(f"{i}|2".encode()).hexdigest())
        starts = [0, *ntile_starts(len(part), 4), len(part)]
        assert all(folds[i] == f for f in range(4) for i in part[starts[f]:starts[f + 1]])


def test_ties_and_empty_frames(spark):
    same = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3, "id long")
    folds = {(r.id, r.fold) for r in kfold_ntile(same, "id", 4).collect()}
    assert len(folds) == 2                                  # rows of one key stay together
    assert kfold_ntile(same.where("id > 5"), "id", 4).count() == 0
    assert holdout_split(same.where("id > 5"), "id").count() == 0
