"""Language identification with language-bitmask n-gram filters.

Every slot of one Bloom filter holds a mask with a bit per language (the filter is bit-sliced: one probe answers for
all languages).  An n-gram is put in under each language in which its share of all n-grams reaches ``min_share``; so a
language has at most ``1 / min_share`` n-grams, whatever the corpus, and the filter that is broadcast has a fixed
number of slots.  A text's n-grams are looked up, bits are counted per language, and each count is corrected for that
language's false-positive rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields, mix64, text_slices

GRAM = 4


@dataclass
class Filters:
    """masks: (words, slots) uint64, bit l % 64 of word l // 64 for language l."""
    langs: list[str]
    masks: np.ndarray
    probes: int
    false_rate: np.ndarray
    prior: int


def _letters() -> np.ndarray:
    """Bytes as they are for letters (lower-cased) and beyond ASCII, one space for all others."""
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def _grams(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte 4-grams of all texts as integers, each word with a space at either end, and their text."""
    n_docs = len(offs) - 1
    lens = np.diff(offs)
    out = np.full(len(raw) + 2 * n_docs, 0x20, np.uint8)       # each text between two spaces
    out[np.arange(len(raw)) + 2 * np.repeat(np.arange(n_docs), lens) + 1] = table[raw]
    doc = np.repeat(np.arange(n_docs), lens + 2)
    blank = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))   # one space between words
    out, doc = out[keep].astype(np.uint32), doc[keep]
    if len(out) < GRAM:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    g = out[:-3] | out[1:-2] << np.uint32(8) | out[2:-1] << np.uint32(16) | out[3:] << np.uint32(24)
    same = doc[:-3] == doc[3:]
    return g[same], doc[:-3][same]


def _slots(g: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return (mix64(g.astype(np.uint64) + np.uint64(probe << 40)) % np.uint64(slots)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all given texts: summed within each task before the shuffle."""

    def count(batches):
        table = _letters()
        names: dict[str, int] = {}
        held: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def merged():
            key, at = np.unique(np.concatenate(held), return_inverse=True)
            return [key], [np.bincount(at, np.concatenate(sums)).astype(np.int64)]

        size = 0
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, raw, offs in text_slices(batch):
                g, doc = _grams(raw, offs, table)
                ids = np.array([names.setdefault(x, len(names)) for x in langs[a:b]], np.uint64)
                key, n = np.unique(ids[doc] << np.uint64(32) | g, return_counts=True)
                held.append(key)
                sums.append(n)
                size += len(key)
                if size > 1 << 21:
                    held, sums = merged()
                    size = len(held[0])
                    if size > 1 << 20:
                        yield rows(names, held[0], sums[0])
                        held, sums, size = [], [], 0
        if held:
            held, sums = merged()
            yield rows(names, held[0], sums[0])

    def rows(names, key, n):
        order = pa.array(list(names))
        return pa.RecordBatch.from_arrays(
            [order.take(pa.array((key >> np.uint64(32)).astype(np.int64))),
             pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    part = fields(docs, "text", "lang").where("text is not null and lang is not null")
    return (part.mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, min_share: float = 2e-5, slots: int = 1 << 20, probes: int = 2,
        contrast: float = 0.02) -> Filters:
    """Learn the filters from ``docs`` (text, lang); rows without either are left out.

    An n-gram is a language's own if its share there is at least ``min_share`` and at least ``contrast`` of its
    largest share in any language (texts quote other languages).  What the driver collects is bounded by
    ``languages / min_share`` n-grams.  No rows: a filter with no languages."""
    n = gram_counts(docs)
    totals = n.groupBy("lang").agg(F.sum("n").alias("total"))
    share = n.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    own = (share.where(F.col("share") >= min_share)
           .groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("at"), F.max("share").alias("top"))
           .select("gram", F.explode("at").alias("x"), "top")
           .where(F.col("x.share") >= F.col("top") * contrast).select("gram", F.col("x.lang").alias("lang"))).toPandas()
    prior = totals.orderBy(F.desc("total"), "lang").toPandas()["lang"].tolist()
    langs = sorted(prior)
    masks = np.zeros(((len(langs) + 63) // 64 or 1, slots), np.uint64)
    rate = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        g = own["gram"].to_numpy(np.uint64)[(own["lang"] == lang).to_numpy()]
        bit = np.uint64(1) << np.uint64(i % 64)
        for k in range(probes):
            masks[i // 64][_slots(g, k, slots)] |= bit
        rate[i] = np.mean(masks[i // 64] & bit != 0) ** probes
    return Filters(langs, masks, probes, rate, langs.index(prior[0]) if prior else 0)


def hit_shares(f: Filters, g: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each text and language the share of its n-grams that the language has, false positives taken off."""
    total = np.bincount(doc, minlength=n_docs)
    found = np.empty((n_docs, len(f.langs)))
    for w, word in enumerate(f.masks):
        mask = word[_slots(g, 0, len(word))]
        for k in range(1, f.probes):
            mask &= word[_slots(g, k, len(word))]
        for i in range(64 * w, min(64 * w + 64, len(f.langs))):
            bit = (mask >> np.uint64(i % 64) & np.uint64(1)).astype(np.float64)
            found[:, i] = np.bincount(doc, bit, minlength=n_docs)
    return np.clip((found / np.maximum(total, 1)[:, None] - f.false_rate) / (1 - f.false_rate), 0, 1)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in place of columns so named.

    score: the corrected share of n-grams found in the predicted language, between 0 and 1.  A null text and one
    without a letter get ``und`` and 0; so does every text if nothing was learned.  Equal shares go to the first name,
    and a text with letters of which no n-gram is known goes to the language with most n-grams, with score 0."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not filters.langs:
        return fields(docs, *names).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def guess(batches):
        f, table = shared.value, _letters()
        langs = np.array(f.langs, dtype=object)
        for batch in batches:
            pred, score = [], []
            for a, b, raw, offs in text_slices(batch, "_text"):
                g, doc = _grams(raw, offs, table)
                s = hit_shares(f, g, doc, b - a)
                best = np.where(s.max(axis=1) > 0, s.argmax(axis=1), f.prior)
                pred.append(langs[best])
                score.append(s[np.arange(b - a), best])
            if pred:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(np.concatenate(pred), pa.string()),
                     pa.array(np.concatenate(score))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    safe = [f"c{i}" for i in range(len(names))]
    plain = fields(docs, *names).toDF(*safe)
    text = safe[names.index("text")]
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", lang_pred string, score double"
    out = plain.withColumn("_text", F.col(text)).mapInArrow(guess, schema)
    known = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return out.select(*[F.col(c).alias(n) for c, n in zip(safe, names)],
                      F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(known, F.col("score")).otherwise(0.0).alias("score"))
