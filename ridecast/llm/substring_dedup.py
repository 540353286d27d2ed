"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words the smallest hash of ``anchor`` words is an anchor, so
two texts that share a window share its anchor at the same place.  An anchor of a text owns the windows that choose it,
a run of neighbouring windows; their words are the anchor's block.  Documents are joined on anchors that occur in more
than one.  Extension goes both ways from the anchor: first to the whole block, which settles runs that two documents have in full
(long repeats are chains of such blocks), then, for the blocks that differ around a shared anchor, window by window.
Equal blocks count once, by their smallest document, so a passage of many copies costs its distinct contexts.
Overlapping matches merge to maximal repeats in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import (fields, find_words, hash_windows, hash_windows_at, hash_words, owners, runs, space_words,
                                 text_slices, window_levels)
from ridecast.session import cut_lineage


def _hashes(batch: pa.RecordBatch):
    """(first row, end row, bytes, word starts, word ends, first words, word hashes) of slices of the texts."""
    table = space_words()
    for a, b, raw, offs in text_slices(batch):
        starts, ends, first = find_words(raw, offs, table)
        yield a, b, raw, offs, starts, ends, first, hash_words(raw, starts, ends)


def _blocks(h: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """The blocks of all texts: text, first window (a word's place in h), windows, anchor hash, block hash."""
    n = len(h)
    if n < window:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    seeds = hash_windows(h, anchor)
    span = window - anchor + 1
    low = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(axis=1) + np.arange(n - window + 1)
    doc = owners(first)
    inside = doc[:n - window + 1] == doc[window - 1:]
    begin = inside.copy()
    begin[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    at = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= (low[1:] != low[:-1]) | ~inside[1:]
    count = np.flatnonzero(stop) + 1 - at
    block = np.zeros(len(at), np.uint64)
    levels = window_levels(h, min(window + int(count.max(initial=1)) - 1, n))
    for c in np.unique(count):                           # at most span lengths
        own = np.flatnonzero(count == c)
        block[own] = hash_windows_at(levels, window + int(c) - 1, at[own]) + np.uint64(c)
    return doc[at], at, count, seeds[low[at]], block


def anchor_blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, anchor, block): one row for each block."""

    def make(batches):
        for batch in batches:
            for a, b, _, _, _, _, first, h in _hashes(batch):
                doc, _, _, seed, block = _blocks(h, first, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(seed.view(np.int64)),
                     pa.array(block.view(np.int64))], names=["doc_id", "anchor", "block"])

    return fields(docs, "doc_id", "text").mapInArrow(make, "doc_id long, anchor long, block long")


def repeat_notes(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, whole, places) of each document with repeats: the blocks that a smaller document has too, and the places
    of single windows that one has."""
    docs = fields(docs, "doc_id", "text").where("doc_id is not null")
    blocks = cut_lineage(anchor_blocks(docs, window, anchor))
    # what is grouped by a key is written before it is joined by that key: a join of two exchanges can split a hot key
    seeds = cut_lineage(blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                        .where("lo < hi").select("anchor"))
    shared = cut_lineage(blocks.join(seeds, "anchor", "left_semi"))
    contexts = cut_lineage(shared.groupBy("anchor", "block").agg(F.min("doc_id").alias("head")))
    settled = (shared.join(contexts, ["anchor", "block"]).where("head < doc_id")
               .groupBy("doc_id").agg(F.collect_set("block").alias("whole")))
    # anchors around which blocks differ: the distinct blocks are compared window by window, each in its first document
    differ = cut_lineage(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    open_ = (contexts.join(differ, "anchor", "left_semi")
             .groupBy(F.col("head").alias("doc_id")).agg(F.collect_set("block").alias("open")))

    def extend(batches):
        for batch in batches:
            open_, out = batch.column(2).to_pylist(), []
            for a, b, _, _, _, _, first, h in _hashes(batch):
                doc, at, count, _, block = _blocks(h, first, window, anchor)
                each = hash_windows(h, window).view(np.int64)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    x, y = cut[d], cut[d + 1]
                    own = np.isin(block[x:y].view(np.int64), np.array(open_[a + d], np.int64))
                    if own.any():
                        place = _ranges(at[x:y][own], count[x:y][own])
                        out.append((a + d, each[place], place - first[d]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]))),
                     pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                    names=["doc_id", "window", "place"])

    windows = cut_lineage(docs.join(open_, "doc_id").select("doc_id", "text", "open")
                          .mapInArrow(extend, "doc_id long, window long, place long"))
    first_in = cut_lineage(windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                           .where("lo < hi").select("window", "lo"))
    partial = (windows.join(first_in, "window").where("lo < doc_id")
               .groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    return settled.join(partial, "doc_id", "full")


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start .. start + len - 1 of every pair, one after the other."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())


def cut_repeats(docs: DataFrame, window: int = 50, anchor: int = 25) -> DataFrame:
    """One row per row of ``docs`` (long doc_id, text): doc_id, n_words, spans, kept_text.

    Words are runs without white space.  Removed is each word inside a window of ``window`` consecutive words
    whose sequence also starts in a document with a smaller doc_id; windows are judged on the input.  Repeats within one
    document stay.  spans: the maximal runs of removed words, [first, end).  kept_text: the other words joined by
    single spaces; null and empty texts give the empty text.  Rows with a null doc_id are never compared and lose
    nothing; rows of one doc_id should have one text."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has between one word and a window's words")
    docs = fields(docs, "doc_id", "text")

    def cut(batches):
        for batch in batches:
            whole, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, spans, kept = [], [], []
            for a, b, raw, _, starts, ends, first, h in _hashes(batch):
                n.append(np.diff(first))
                doc, at, count, _, block = _blocks(h, first, window, anchor)
                of = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    x, y, size = of[d], of[d + 1], int(first[d + 1] - first[d])
                    gone = np.zeros(size, bool)
                    if whole[a + d] or places[a + d]:
                        edge = np.zeros(size + 1, np.int64)
                        own = np.isin(block[x:y].view(np.int64), np.array(whole[a + d] or [], np.int64))
                        np.add.at(edge, at[x:y][own] - first[d], 1)
                        np.add.at(edge, at[x:y][own] - first[d] + count[x:y][own] + window - 1, -1)
                        p = np.array(places[a + d] or [], np.int64)
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + window, -1)
                        gone = np.cumsum(edge)[:size] > 0
                    i, j = runs(gone)
                    spans.append([{"first": int(u), "end": int(v)} for u, v in zip(i, j)])
                    words = slice(first[d], first[d + 1])
                    kept.append(_joined(raw, starts[words][~gone], ends[words][~gone]))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept_text"])

    return (docs.join(repeat_notes(docs, window, anchor), "doc_id", "left").select("doc_id", "text", "whole", "places")
            .mapInArrow(cut, "doc_id long, n_words long, spans array<struct<first: long, end: long>>, kept_text string"))


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    src = _ranges(starts, sizes)
    out = raw[np.minimum(src, len(raw) - 1)]
    out[np.cumsum(sizes) - 1] = 0x20
    return out[:-1].tobytes()
