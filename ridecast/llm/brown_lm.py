"""Brown class-based bigrams: p(w | v) = p(class(w) | class(v)) * p(w | class(w)).

Words are assigned to classes by exchange: from the class to which a unit would give the training text the
highest likelihood, all others standing still (the distributed form: half of the units move at a time, then all counts
are taken anew).  A unit is a frequent word, or all rarer words that end in one group of suffixes; a rare word has its
suffix group's class and its own emission probability.

Everything is counted over all training texts.  What is broadcast is bounded by shares of the token count: at most
``1 / unit_share`` units and ``1 / known_share`` word counts; the counts of rarer words stay in a table that the scored
words are joined with.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields, find_words, hash_words, lower_table, mix64, space_words, text_slices
from ridecast.session import cut_lineage

SUFFIXES = 4096
END = np.uint64(0x5BD1E9955BD1E995)


@dataclass
class Model:
    units: np.ndarray            # sorted hashes of the frequent words; suffix groups are numbered after them
    classes: np.ndarray          # class of each unit
    known: np.ndarray            # sorted hashes of words counted here, and their counts
    known_n: np.ndarray
    step: np.ndarray             # log10 p(class | class before)
    spread: np.ndarray           # log10 of each class's emission denominator
    add: float                   # added to every count within a class
    tokens: int
    types: int
    counts: DataFrame | None = None   # (h, n) of all words
    trail: tuple[float, ...] = ()     # natural-log likelihood per token of the classes, before each exchange


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix group of every token, each text's end among them, and each text's first token."""
    raw = lower_table()[raw]
    starts, ends, first = find_words(raw, offs, space_words())
    h = hash_words(raw, starts, ends)
    tail = np.zeros(len(h), np.uint64)
    for j in range(1, 4):
        at = ends - j
        tail |= np.where(at >= starts, raw[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * j)
    group = (mix64(tail) % np.uint64(SUFFIXES)).astype(np.int64)
    return np.insert(h, first[1:], END), np.insert(group, first[1:], 0), first + np.arange(len(first))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _units(units: np.ndarray, h: np.ndarray, group: np.ndarray) -> np.ndarray:
    at = _find(units, h)
    return np.where(at >= 0, at, len(units) + group)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, g, n): hash, suffix group and count of every distinct token of the texts, ends included."""

    def count(batches):
        held: list[tuple] = []

        def merged():
            h, at, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return (h, np.concatenate([x[1] for x in held])[at],
                    np.bincount(back, np.concatenate([x[2] for x in held])).astype(np.int64))

        size = 0
        for batch in batches:
            for _, _, raw, offs in text_slices(batch):
                h, group, _ = _tokens(raw, offs)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((h, group[at], n))
                size += len(h)
                if size > 1 << 21:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())

    def rows(h, group, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(group.astype(np.int32)), pa.array(n)],
                                          names=["h", "g", "n"])

    return (fields(train, "text").mapInArrow(count, "h long, g int, n long")
            .groupBy("h").agg(F.max("g").alias("g"), F.sum("n").alias("n")))


def _sequences(train: DataFrame, units: np.ndarray) -> DataFrame:
    """The texts as runs of unit numbers, each run starting and every text closing with the end unit."""
    shared = train.sparkSession.sparkContext.broadcast(units)

    def code(batches):
        close = np.uint32(_find(shared.value, np.array([END]))[0])
        for batch in batches:
            out = []
            for _, _, raw, offs in text_slices(batch):
                h, group, _ = _tokens(raw, offs)
                out.append(np.concatenate(([close], _units(shared.value, h, group).astype("<u4"))).astype("<u4"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out], pa.binary())], names=["run"])

    return cut_lineage(fields(train, "text").mapInArrow(code, "run binary"))


def _contexts(seqs: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the classes before and after each unit: two arrays of units x classes."""
    shared = seqs.sparkSession.sparkContext.broadcast(classes)
    names = [f"l{i}" for i in range(k)] + [f"r{i}" for i in range(k)]

    def count(batches):
        c = shared.value
        sums = np.zeros((2, len(c) * k), np.int64)
        for batch in batches:
            for run in batch.column(0):
                u = np.frombuffer(run.as_py(), "<u4").astype(np.int64)
                of = c[u]
                sums[0] += np.bincount(u[1:] * k + of[:-1], minlength=len(c) * k)
                sums[1] += np.bincount(u[:-1] * k + of[1:], minlength=len(c) * k)
        table = np.concatenate((sums[0].reshape(-1, k), sums[1].reshape(-1, k)), axis=1)
        met = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met)] + [pa.array(table[met, i]) for i in range(2 * k)],
                                         names=["unit", *names])

    out = (seqs.mapInArrow(count, "unit long, " + ", ".join(f"{x} long" for x in names))
           .groupBy("unit").agg(*[F.sum(x).alias(x) for x in names]).toPandas())       # units rows at most
    table = np.zeros((len(classes), 2 * k))
    table[out["unit"].to_numpy(np.int64)] = out[names].to_numpy(np.float64)
    return table[:, :k], table[:, k:]


def _exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, movable: np.ndarray,
              blur: float = 0.5) -> tuple[np.ndarray, float]:
    """Move the movable units to their best classes; also the likelihood per token of the classes as they were."""
    k = before.shape[1]
    t = np.zeros((k, k))
    np.add.at(t.T, classes, before)                      # t[c, d]: class d after class c
    total = np.maximum(t.sum(axis=0), 1e-9)
    xlog = lambda x: float(np.sum(x[x > 0] * np.log(x[x > 0])))                          # noqa: E731
    likely = (xlog(t) - 2 * xlog(total) + xlog(n.astype(float))) / max(n.sum(), 1)
    log_t = np.log(t + blur)
    out = after.sum(axis=1)
    score = before @ (log_t - np.log(total)[:, None]) + after @ log_t.T - (n + out)[:, None] * np.log(total)
    own = classes                                        # in its own class a unit counts without itself
    into = np.log(np.maximum(t[:, own].T - before, 0) + blur) - np.log(total)
    away = np.log(np.maximum(t[own] - after, 0) + blur)
    rest = np.log(np.maximum(total[own] - n, 1))
    at = np.arange(len(own))
    score[at, own] = (before * into).sum(axis=1) + (after * away).sum(axis=1) - (n + out) * rest
    score[:, 0] = -np.inf                                # class 0 is the end's alone
    return np.where(movable, score.argmax(axis=1), classes), likely


def fit(train: DataFrame, classes: int = 32, exchanges: int = 6, unit_share: float = 2.0 ** -14,
        known_share: float = 2.0 ** -20, add: float = 0.5, prior: float = 10.0) -> Model:
    """Learn from the texts of ``train`` (null: empty).  Without rows every token is unknown.

    Transitions are smoothed towards class frequencies with weight ``prior``; each class gives ``add`` to each of its words
    and to one unknown word, so that the probabilities after any word sum to one over the known words and an unknown
    one of each class.  Ties in counts go by hash."""
    counts = cut_lineage(word_counts(train))
    tokens, types = counts.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    close = np.int64(END.view(np.int64))
    often = (counts.where((F.col("n") >= max(1, math.ceil(tokens * known_share))) | (F.col("h") == int(close)))
             .select("h", "n").toPandas())               # 1 / known_share rows at most
    h, n = often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    own = (n >= max(1, math.ceil(tokens * unit_share))) | (h == END)
    units = h[own] if tokens else np.array([END])
    unit_n = n[own] if tokens else np.zeros(1, np.int64)
    spark = train.sparkSession
    named = spark.createDataFrame([(int(x),) for x in units.view(np.int64)], "h long")
    tails = (counts.join(F.broadcast(named), "h", "left_anti").groupBy("g")
             .agg(F.count("*").alias("types"), F.sum("n").alias("n")).toPandas())       # SUFFIXES rows at most
    total = np.concatenate((unit_n, np.zeros(SUFFIXES, np.int64)))
    kinds = np.concatenate((np.ones(len(units), np.int64), np.zeros(SUFFIXES, np.int64)))
    total[len(units) + tails["g"].to_numpy(np.int64)] = tails["n"].to_numpy(np.int64)
    kinds[len(units) + tails["g"].to_numpy(np.int64)] = tails["types"].to_numpy(np.int64)
    end = int(_find(units, np.array([END]))[0])
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    of = rank % (classes - 1) + 1                        # by frequency in turn; class 0 is the end's
    of[end] = 0
    half = (mix64(np.arange(len(total), dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    seqs = _sequences(train, units)
    trail = []
    for turn in range(exchanges):
        before, after = _contexts(seqs, of, classes)
        free = (half == turn % 2) & (total > 0)
        free[end] = False
        of, likely = _exchange(of, before, after, total, free)
        trail.append(likely)
    before, _ = _contexts(seqs, of, classes)
    t = np.zeros((classes, classes))
    np.add.at(t.T, of, before)
    mass = np.bincount(of, total, minlength=classes)
    share = (mass + 1) / (mass.sum() + classes)
    step = np.log10((t + prior * share) / (t.sum(axis=1, keepdims=True) + prior))
    spread = np.log10(mass + add * (np.bincount(of, kinds, minlength=classes) + 1))
    return Model(units, of.astype(np.int64), h, n, step, spread, add, int(tokens), int(types),
                 counts.select("h", "n"), tuple(trail))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score.

    A text's tokens are its words (runs without white space, A-Z lower-cased) and one end; null is the empty text.  score:
    log10 probability of the text under the classes.  base_score: under add-one unigrams.  n_known: tokens that
    training has met.  Rows that repeat are scored one by one."""
    sc = docs.sparkSession.sparkContext
    arrays = {k: v for k, v in vars(model).items() if k not in ("counts", "trail")}
    shared = sc.broadcast(arrays)
    base = math.log10(model.tokens + model.types + 1)

    def read(batches):
        m = Model(**shared.value)
        for batch in batches:
            parts, ids = [], batch.schema.field(1).type
            for a, b, raw, offs in text_slices(batch):
                h, group, first = _tokens(raw, offs)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                c = m.classes[_units(m.units, h, group)]
                prev = np.empty_like(c)
                prev[1:] = c[:-1]
                prev[first[:-1]] = 0
                at = _find(m.known, h)
                n = np.where(at >= 0, m.known_n[at], 0) if len(m.known) else np.zeros(len(h), np.int64)
                flow = m.step[prev, c] - m.spread[c]
                here = at >= 0
                sums = lambda x: np.bincount(doc, x, minlength=b - a)                    # noqa: E731
                parts.append(pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.full(b - a, None), pa.int64()),
                    pa.array(np.zeros(b - a, np.int64)), pa.array(np.diff(first)),
                    pa.array(sums(here.astype(float)).astype(np.int64)),
                    pa.array(sums(np.where(here, np.log10(n + 1), 0))),
                    pa.array(sums(flow + np.where(here, np.log10(n + m.add), 0))),
                    batch.column(1).slice(a, b - a)], names=COLUMNS))
                rare = np.flatnonzero(~here)
                if len(rare):
                    order = rare[np.lexsort((h[rare], doc[rare]))]
                    hr, dr = h[order], doc[order]
                    new = np.flatnonzero(np.concatenate(([True], (hr[1:] != hr[:-1]) | (dr[1:] != dr[:-1]))))
                    none = pa.nulls(len(new), pa.int64())
                    parts.append(pa.RecordBatch.from_arrays([
                        batch.column(0).slice(a, b - a).take(pa.array(dr[new])), pa.array(hr[new].view(np.int64)),
                        pa.array(np.diff(np.append(new, len(hr)))), none, none, pa.nulls(len(new), pa.float64()),
                        pa.nulls(len(new), pa.float64()), pa.nulls(len(new), ids)], names=COLUMNS))
            yield from parts

    rows = (fields(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", "text")
            .mapInArrow(read, ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, [*KINDS, dict(docs.dtypes)["doc_id"]]))))
    # a text's own row has no word: a random key keeps these rows apart, and it matches nothing that counts
    keyed = rows.withColumn("key", F.coalesce("h", F.xxhash64("row")))
    counts = model.counts.select(F.col("h").alias("key"), F.col("n").alias("c"))
    c = F.coalesce(F.when(F.col("h").isNotNull(), F.col("c")), F.lit(0))
    times = F.col("times")
    word = F.col("h").isNotNull()
    sums = (keyed.join(counts, "key", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(word, F.when(c > 0, times).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(word, times * F.log10(c + 1)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(word, times * F.log10(c + model.add)).otherwise(F.col("model"))).alias("model")))
    return sums.select(
        "doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
        (F.col("base") - F.col("n_tokens") * F.lit(base)).alias("base_score"), F.col("model").alias("score"),
        F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"))


#: One row per text (h is null), and one for each distinct word of it whose count is not broadcast.
COLUMNS = ["row", "h", "times", "n_tokens", "n_known", "base", "model", "doc_id"]
KINDS = ["long", "long", "long", "long", "long", "double", "double"]
