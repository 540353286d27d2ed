"""Category codes, one-hot columns, column alignment and merged rare values.

Category codes are a fitted dictionary: distinct non-null values in binary
(code-point) order, numbered from 0; unseen values and nulls get -1.  How the
dictionary is applied depends on its counted size:

* up to ``INLINE_LIMIT`` values: a literal map inside the projection (no join,
  stays in whole-stage codegen);
* up to ``BROADCAST_LIMIT`` values: a broadcast hash join against the
  checkpointed dictionary;
* above: a shuffle join, the dictionary numbered by the distributed global
  rank (no single-task window).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ridecast.operators.rank import global_rank
from ridecast.session import cut_lineage

INLINE_LIMIT = 1024
BROADCAST_LIMIT = 200_000
ONE_HOT_LIMIT = 1024


@dataclass
class _Dictionary:
    column: str
    size: int
    values: list | None = None          # inline form
    frame: DataFrame | None = None      # (value, code) form
    broadcastable: bool = False


@dataclass
class CategoryCodes:
    """Fit on one frame, apply to others (train -> scoring set)."""
    columns: list[str]
    inline_limit: int = INLINE_LIMIT
    broadcast_limit: int = BROADCAST_LIMIT
    dictionaries: dict = field(default_factory=dict)
    kinds: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "CategoryCodes":
        """One pass over ``df`` for all columns: the distinct (column, value)
        pairs of every same-typed group of columns are computed together
        (partial aggregation map-side) and checkpointed; sizes, inline values
        and the larger dictionaries are then read from that small table."""
        by_type: dict = {}
        self.kinds = {c: df.schema[c].dataType.simpleString() for c in self.columns}
        for c in self.columns:
            by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
        for kind, cols in by_type.items():
            present = F.col("value").isNotNull()
            if kind in ("float", "double"):
                present &= ~F.isnan("value")                    # NaN counts as null: code -1 in every form
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
            distinct = (df.select(F.explode(pairs).alias("_p")).select("_p.*")
                        .where(present).distinct())
            # fast path, one job: when all pairs fit the inline budget they are
            # collected directly (bounded: at most inline_limit x columns rows)
            budget = self.inline_limit * len(cols)
            head = distinct.limit(budget + 1).collect() if budget > 0 else [None]
            if len(head) <= budget:
                for c in cols:
                    vals = sorted(r[1] for r in head if r[0] == c)
                    self.dictionaries[c] = _Dictionary(c, len(vals), values=vals)
                continue
            distinct = cut_lineage(distinct)
            sizes = {r[0]: r[1] for r in distinct.groupBy("column").count().collect()}   # one row per column
            small = [c for c in cols if sizes.get(c, 0) <= self.inline_limit]
            values: dict = {c: [] for c in small}
            if small:
                for r in distinct.where(F.col("column").isin(small)).collect():      # bounded: inline_limit each
                    values[r[0]].append(r[1])
            for c in cols:
                n = sizes.get(c, 0)
                one = distinct.where(F.col("column") == c).select("value")
                if c in values:
                    self.dictionaries[c] = _Dictionary(c, n, values=sorted(values[c]))
                elif n <= self.broadcast_limit:
                    w = Window.orderBy("value")                                   # <= broadcast_limit rows
                    frame = one.select("value", (F.row_number().over(w) - 1).cast("int").alias("code"))
                    self.dictionaries[c] = _Dictionary(c, n, frame=cut_lineage(frame), broadcastable=True)
                else:
                    frame = global_rank(one, ["value"], name="code")
                    self.dictionaries[c] = _Dictionary(c, n, frame=frame.select("value", F.col("code").cast("int")))
        return self

    def categories(self, col: str) -> list | None:
        d = self.dictionaries[col]
        return d.values

    def frame(self, spark, col: str) -> DataFrame:
        """(value, code) of a fitted column, whatever its size."""
        d = self.dictionaries[col]
        if d.values is None:
            return d.frame.select("value", "code")
        kind = self.kinds[col]
        return spark.createDataFrame([(v, i) for i, v in enumerate(d.values)], f"value {kind}, code int")

    def _inline(self, d: _Dictionary) -> Column:
        if not d.values:
            return F.lit(-1).cast("int")
        m = F.create_map(*[x for i, v in enumerate(d.values) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.element_at(m, F.col(d.column)), F.lit(-1)).cast("int")

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace each fitted column by its code (or add ``col+suffix``)."""
        out = df
        for c in self.columns:
            d = self.dictionaries[c]
            target = c + suffix
            if d.values is not None:
                out = out.withColumn(target, self._inline(d))
                continue
            tmp_v, tmp_c = f"_dv_{c}", f"_dc_{c}"
            right = d.frame.select(F.col("value").alias(tmp_v), F.col("code").alias(tmp_c))
            right = F.broadcast(right) if d.broadcastable else right
            out = out.join(right, out[c] == right[tmp_v], "left") \
                .withColumn(target, F.coalesce(F.col(tmp_c), F.lit(-1)).cast("int")).drop(tmp_v, tmp_c)
        return out

    def fit_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return self.fit(df).transform(df, suffix)


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def encode_all_strings(df: DataFrame, exclude=(), **kw) -> DataFrame:
    """Code every string column of the schema with its own fitted dictionary."""
    cols = string_columns(df, exclude)
    return CategoryCodes(cols, **kw).fit_transform(df) if cols else df


def one_hot(df: DataFrame, col: str, values: list | None = None, prefix: str | None = None,
            drop_source: bool = True, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """One 0/1 integer column per category value, named ``prefix_value``,
    appended in sorted value order; a null sets none.  Passing ``values``
    fixes the output schema at plan time (fit once on train, reuse on test)."""
    if values is None:
        distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
        values = [r[0] for r in distinct.orderBy(col).limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{col} has more than {limit} categories: a column for each is too many, use SparseOneHot")
    prefix = col if prefix is None else prefix
    new = [F.when(F.col(col) == v, 1).otherwise(0).cast("int").alias(f"{prefix}_{v}") for v in values]
    out = df.select("*", *new)
    return out.drop(col) if drop_source else out


@dataclass
class SparseOneHot:
    """One-hot at any number of categories: one sparse vector a row instead of a column a category.

    Fitted on one frame, it gives vectors of the same width on every other: the columns' dictionaries side by side, each
    in value order.  Null, NaN and unseen values set nothing in their column's part."""
    columns: list[str]
    out: str = "features"
    codes: CategoryCodes | None = None
    encoder: object = None

    def fit(self, df: DataFrame) -> "SparseOneHot":
        from pyspark.ml.feature import OneHotEncoder
        self.codes = CategoryCodes(self.columns).fit(df)
        # the encoder learns sizes from the greatest code: one row of them; one more code stands for all that set nothing
        sizes = [float(self.codes.dictionaries[c].size) for c in self.columns]
        greatest = df.sparkSession.createDataFrame([tuple(max(n - 1, 0.0) for n in sizes)],
                                                   ", ".join(f"i{k} double" for k in range(len(sizes))))
        names = [f"i{k}" for k in range(len(sizes))]
        self.encoder = OneHotEncoder(inputCols=names, outputCols=[f"v{k}" for k in range(len(names))], handleInvalid="keep",
                                     dropLast=True).fit(greatest)
        return self

    @property
    def width(self) -> int:
        return sum(max(self.codes.dictionaries[c].size, 1) for c in self.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector column ``out`` in the place of the fitted columns."""
        from pyspark.ml.feature import VectorAssembler
        rest = [F.col(f"`{c}`") for c in df.columns if c not in self.columns]
        row = max([*self.columns, ""], key=len) + "_row"            # no fitted column has this name
        coded = self.codes.transform(df.select(F.struct(*rest).alias(row) if rest else F.lit(None).alias(row),
                                               *[F.col(f"`{c}`") for c in self.columns]))
        sizes = [max(self.codes.dictionaries[c].size, 1) for c in self.columns]
        coded = coded.select(F.col(f"`{row}`").alias("row"), *[
            F.when(F.col(f"`{c}`") < 0, float(n)).otherwise(F.col(f"`{c}`")).cast("double").alias(f"i{k}")
            for k, (c, n) in enumerate(zip(self.columns, sizes))])
        parts = [f"v{k}" for k in range(len(sizes))]
        out = VectorAssembler(inputCols=parts, outputCol="vector").transform(self.encoder.transform(coded))
        return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in self.columns], F.col("vector").alias(self.out))


def align_columns(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in that order: missing ones are the constant
    ``fill``, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])


def rare_to_other(df: DataFrame, values: list[str], other: str = "other", subset=None) -> DataFrame:
    """Replace any of ``values`` by ``other`` in every string column (or ``subset``)."""
    cols = subset if subset is not None else string_columns(df)
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).isin(list(values)), F.lit(other)).otherwise(F.col(c)))
    return out


def auto_features(df: DataFrame, index: str | None = None, order: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Type-driven features from one table: for every date/timestamp column its
    day, year, month and weekday (Monday = 0); for every string column its
    number of characters and words.  With ``index``, a 0-based row id in the
    total order ``order`` is added (distributed, not a single-task window)."""
    feats = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            feats += [F.dayofmonth(c).cast("int").alias(f"DAY({f.name})"),
                      F.year(c).cast("int").alias(f"YEAR({f.name})"),
                      F.month(c).cast("int").alias(f"MONTH({f.name})"),
                      F.weekday(c).cast("int").alias(f"WEEKDAY({f.name})")]
        elif isinstance(f.dataType, StringType):
            words = F.when(F.trim(c) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(c), r"\s+")))
            feats += [F.length(c).cast("int").alias(f"NUM_CHARACTERS({f.name})"),
                      words.cast("int").alias(f"NUM_WORDS({f.name})")]
    out = df.select("*", *feats)
    if index:
        out = global_rank(out, order or df.columns, name=index, partitions=partitions)
    return out
