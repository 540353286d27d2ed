"""Distributed selection: the rows at given ranks of an order, without sorting or moving rows.

The order key becomes a whole number that keeps the order.  One aggregation counts rows in ``BUCKETS`` equal parts of each
range that holds a wanted rank; the part with the rank is the next, narrower range.  Once few rows are left in it (or only
equal numbers), their full keys are collected.  Each pass reads the key column alone and shuffles counts alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
FEW = 1000              # rows of a range that are collected, for each wanted rank
LOWEST = -(1 << 63)


def order_number(c: Column, kind: T.DataType) -> Column:
    """A long that does not fall where the column rises; null is lowest."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = c.cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        n = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")                            # whole part: finer differences are left to the full keys
        n = F.when(F.isnan(d), F.lit((1 << 63) - 1)).otherwise(F.floor(F.greatest(F.least(d, F.lit(2.0 ** 62)), F.lit(-2.0 ** 62))))
    elif isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0")
        n = F.conv(head, 16, 10).cast("long")
    else:
        raise TypeError(f"no order number for {kind.simpleString()}")
    return F.coalesce(n.cast("long"), F.lit(LOWEST))


@dataclass
class _Target:
    group: object
    rank: int           # among the rows of lo <= number <= hi
    lo: int
    hi: int
    rows: int


def rows_at(df: DataFrame, order: list[Column], ranks: dict | None = None, group: Column | None = None,
            plan=None) -> dict:
    """{group: [key of the row at each 0-based rank, as a tuple]} of the order by the columns ``order``.

    ``ranks`` maps a group to its ranks; or ``plan`` makes a group's ranks from its number of rows.  Without ``group``
    there is one, None.  Null groups are a group; ranks beyond the rows are left out.  Equal keys are one key."""
    names = [f"o{i}" for i in range(len(order))]
    keys = df.select((group if group is not None else F.lit(None).cast("string")).alias("g"),
                     *[c.alias(n) for c, n in zip(order, names)])
    keys = keys.withColumn("n", order_number(F.col("o0"), keys.schema["o0"].dataType))
    stats = keys.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("rows")).collect()
    wanted = {r["g"]: (plan(r["rows"]) if plan else (ranks or {}).get(r["g"], [])) for r in stats}
    targets = [(i, _Target(r["g"], k, r["lo"], r["hi"], r["rows"])) for r in stats
               for i, k in enumerate(wanted[r["g"]]) if 0 <= k < r["rows"]]
    while wide := [t for _, t in targets if t.rows > FEW and t.lo < t.hi]:
        ranges = {}
        for t in wide:
            ranges.setdefault((t.group, t.lo, t.hi), []).append(t)
        for (at, (g, lo, hi)), counts in _histograms(keys, list(ranges)).items():
            width = (hi - lo) // BUCKETS + 1
            for t in ranges[g, lo, hi]:
                bucket, below = None, 0
                for b, n in counts:
                    if below + n > t.rank:
                        bucket = b
                        break
                    below += n
                t.rank, t.rows, t.lo, t.hi = t.rank - below, n, lo + bucket * width, min(lo + (bucket + 1) * width - 1, hi)
    out: dict = {r["g"]: [] for r in stats}
    left = {(t.group, t.lo, t.hi) for _, t in targets}
    found = _collect(keys, list(left), names)
    for _, t in targets:
        below = 0
        for key, n in found[t.group, t.lo, t.hi]:
            if below + n > t.rank:
                out[t.group].append(key)
                break
            below += n
    return out


def _inside(ranges: list[tuple]) -> Column:
    """An array of the numbers of the ranges that a row lies in."""
    return F.array_compact(F.array(*[F.when(
        F.col("g").eqNullSafe(F.lit(g)) & F.col("n").between(F.lit(lo), F.lit(hi)), F.lit(i))
        for i, (g, lo, hi) in enumerate(ranges)]))


def _histograms(keys: DataFrame, ranges: list[tuple]) -> dict:
    """{(range number, range): [(bucket, rows), …] by bucket}"""
    low = F.array(*[F.lit(lo) for _, lo, _ in ranges])
    width = F.array(*[F.lit((hi - lo) // BUCKETS + 1) for _, lo, hi in ranges])
    each = keys.select("n", F.explode(_inside(ranges)).alias("i"))
    # both ends as decimals: a difference of two longs may not fit one
    offset = F.col("n").cast("decimal(20,0)") - F.get(low, "i").cast("decimal(20,0)")
    bucket = F.call_function("div", offset, F.get(width, "i").cast("decimal(20,0)")).cast("int")
    counts = each.groupBy("i", bucket.alias("b")).agg(F.count("*").alias("rows")).collect()
    out: dict = {(i, r): [] for i, r in enumerate(ranges)}
    for r in sorted(counts, key=lambda r: (r["i"], r["b"])):
        out[r["i"], ranges[r["i"]]].append((r["b"], r["rows"]))
    return out


def _collect(keys: DataFrame, ranges: list[tuple], names: list[str]) -> dict:
    """The different full keys of each range with their counts, in order: few rows, or rows of one order number."""
    out: dict = {r: [] for r in ranges}
    if not ranges:
        return out
    rows = keys.select(*names, F.explode(_inside(ranges)).alias("i")).groupBy("i", *names).agg(F.count("*").alias("rows"))
    for r in rows.orderBy("i", *names).collect():
        out[ranges[r["i"]]].append((tuple(r[n] for n in names), r["rows"]))
    return out


def at_least(order: list[Column], key: tuple) -> Column:
    """Whether a row's order key is not before ``key``; nulls come first."""
    out = F.lit(True)
    for c, v in reversed(list(zip(order, key))):
        if v is None:
            out = F.when(c.isNull(), out).otherwise(F.lit(True))
        else:
            out = F.when(c.isNull(), F.lit(False)).when(c > F.lit(v), F.lit(True)).when(c == F.lit(v), out).otherwise(F.lit(False))
    return out
