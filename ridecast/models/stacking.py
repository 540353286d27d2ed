"""A stacking transformer: fitted once, it keeps a model for every fold and learner and transforms any frame."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.param import Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.models.ensemble import fit_all
from ridecast.operators.folds import stratified_cuts, stratified_fold


class StackingTransformer:
    """Out-of-fold predictions of several learners as features for a second level.

    Rows are dealt to ``folds`` folds by an order of their own, md5 of key and seed, within strata of the label: ``strata``
    quantile classes, or one (``strata=1``).  Fold sizes of a stratum differ by one at most, and no row is sorted or moved:
    the cuts between folds are found by selection.  ``fit`` trains each learner once per fold on the other folds."""

    def __init__(self, learners: dict, folds: int = 5, strata: int = 10, seed: int = 0, key: str = "ride_id",
                 label: str = "label", parallelism: int = 4):
        self.learners, self.folds, self.strata, self.seed = dict(learners), folds, strata, seed
        self.key, self.label, self.parallelism = key, label, parallelism

    def fit(self, train: DataFrame) -> "StackingModel":
        cuts = stratified_cuts(train, self.key, self.label, self.folds, self.strata, self.seed)
        # learners read their rows several times: rows are dealt once, with the columns alone that the learners name
        given = [v for learner in self.learners.values() for v in learner.extractParamMap().values()]
        plain = not any(isinstance(v, Params) for v in given)          # the columns of a learner's own estimators are not known here
        named = {v for v in given if isinstance(v, str)}
        dealt = train.select(*[c for c in train.columns if c in named or not plain], stratified_fold(self.key, self.label, cuts, self.seed)
                             .alias("_fold")).persist()
        jobs = [(i, name) for i in range(self.folds) for name in self.learners]
        try:
            models = fit_all([lambda i=i, name=name: self.learners[name].fit(dealt.where(F.col("_fold") != i))
                              for i, name in jobs], self.parallelism)
        finally:
            dealt.unpersist()
        return StackingModel(dict(zip(jobs, models)), list(self.learners), self.folds, cuts, self.seed, self.key, self.label)


class StackingModel:
    """The fitted K x J models, and the cuts that say which fold a training row belongs to."""

    def __init__(self, models: dict, names: list[str], folds: int, cuts: dict, seed: int, key: str, label: str):
        self.models, self.names, self.folds, self.cuts = models, names, folds, cuts
        self.seed, self.key, self.label = seed, key, label

    def _with(self, df: DataFrame, columns: dict) -> DataFrame:
        for name, model in columns.items():
            df = model.copy({model.getParam("predictionCol"): name}).transform(df)
        return df

    def transform(self, df: DataFrame, prefix: str = "oof_") -> DataFrame:
        """New rows: per learner the mean of its fold models, as ``prefix`` + name.  One pass, no join."""
        own = {f"_f{i}_{n}": m for (i, n), m in self.models.items()}
        out = self._with(df, own)
        for n in self.names:
            out = out.withColumn(prefix + n, sum((F.col(f"_f{i}_{n}") for i in range(self.folds)), F.lit(0.0)) / self.folds)
        return out.drop(*own)

    def transform_train(self, train: DataFrame, prefix: str = "oof_") -> DataFrame:
        """The rows that were fitted: per learner the prediction of the model that has not seen the row's fold."""
        dealt = train.withColumn("_fold", stratified_fold(self.key, self.label, self.cuts, self.seed))
        blocks = [self._with(dealt.where(F.col("_fold") == i), {prefix + n: self.models[i, n] for n in self.names})
                  for i in range(self.folds)]
        return reduce(DataFrame.unionByName, blocks).drop("_fold")

    def save(self, path: str) -> None:
        """Writes every model under ``path`` (models with a ``write``, and level-grown trees), and a table of the rest."""
        import json
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        kinds = {}
        for (i, n), m in self.models.items():
            if hasattr(m, "to_rows"):
                spark.createDataFrame([(x,) for x in m.to_rows()], "tree string").write.mode("overwrite").parquet(f"{path}/{i}_{n}")
                kinds[f"{i}_{n}"] = ""
            else:
                m.write().overwrite().save(f"{path}/{i}_{n}")
                kinds[f"{i}_{n}"] = f"{type(m).__module__}.{type(m).__name__}"
        rest = {"names": self.names, "folds": self.folds, "seed": self.seed, "key": self.key, "label": self.label,
                "kinds": kinds, "cuts": self.cuts}
        spark.createDataFrame([(json.dumps(rest),)], "rest string").write.mode("overwrite").parquet(f"{path}/rest")

    @classmethod
    def load(cls, path: str) -> "StackingModel":
        import importlib
        import json
        from pyspark.sql import SparkSession
        from ridecast.models.trees import TreesModel
        spark = SparkSession.getActiveSession()
        rest = json.loads(spark.read.parquet(f"{path}/rest").first()[0])
        models = {}
        for at, kind in rest["kinds"].items():
            i, n = at.split("_", 1)
            if kind:
                module, name = kind.rsplit(".", 1)
                models[int(i), n] = getattr(importlib.import_module(module), name).load(f"{path}/{at}")
            else:
                models[int(i), n] = TreesModel.from_rows([r[0] for r in spark.read.parquet(f"{path}/{at}").collect()])
        return cls(models, rest["names"], rest["folds"], rest["cuts"], rest["seed"], rest["key"], rest["label"])
