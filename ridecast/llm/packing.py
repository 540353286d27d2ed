"""Vector best-fit packing of documents into token sequences.

A sequence is a bin with three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces are taken longest first; among the open bins in which a piece fits under every capacity, the bin is
chosen by the weighted residual norm that it would be left with, or by the weighted dot product of the piece's and the
bin's vectors.  Pieces are dealt at random into groups of a fixed expected size; a group is one task's work.  What the
groups leave in bins that are not nearly full is dealt anew and packed once more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields
from ridecast.llm.tokens import encoder
from ridecast.session import cut_lineage


@dataclass(frozen=True)
class Capacities:
    """tokens, documents and attention: what a sequence holds at most (None: no bound).  weights: of the three residuals.
    rule: ``norm`` (least weighted residual norm) or ``dot`` (least weighted dot product of piece and residual)."""
    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-3)
    rule: str = "norm"


def sequence(tokens: int) -> Capacities:
    """Capacities for sequences of ``tokens`` that cost no sequence: pieces have a token at least, so there are at most
    ``tokens``, and the sum of their squared lengths is at most the square of their sum.  All three residuals weigh in."""
    return Capacities(tokens=tokens, documents=tokens, attention=tokens ** 2)


def token_pieces(docs: DataFrame, path: str, length: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every text's token ids followed by ``end``: doc_id, piece, start, length, ids_crc32 (of little-endian
    unsigned 32-bit ids), and with ``with_ids`` those bytes.  A longer document is cut every ``length`` tokens.  Null and
    empty texts have one piece, of the end id alone."""

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            which, piece, size, crc, raw = [], [], [], [], []
            for row, ids in enumerate(enc.encode(batch)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), length)):
                    part = ids[a:a + length].tobytes()
                    which.append(row)
                    piece.append(k)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            cols = {"doc_id": batch.column(0).take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(np.array(piece, np.int64) * length), "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())} | ({"ids": pa.array(raw, pa.binary())} if with_ids else {})
            yield pa.RecordBatch.from_pydict(cols)

    kind = dict(docs.dtypes)["doc_id"]
    return fields(docs, "doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  Longest first, equal lengths in the order given."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    big = np.array([caps.tokens, caps.documents or np.inf, caps.attention or np.inf])
    scale = np.where(np.isfinite(big), big, [1, max(n, 1), caps.tokens ** 2])
    weights = np.array(caps.weights) / scale ** 2
    left = np.empty((3, max(n, 1)))                       # what the open bins have left
    name = np.empty(max(n, 1), np.int64)                  # and their numbers
    opened = made = 0
    least = int(lengths.min()) if n else 0
    for i in order:
        size = int(lengths[i])
        item = np.array([size, 1.0, float(size) ** 2])
        if np.any(item > big):
            raise ValueError(f"a piece of {size} tokens exceeds a sequence's capacities")
        open_left = left[:, :opened]
        fits = np.flatnonzero(open_left[0] >= size)
        if caps.documents or caps.attention:
            fits = fits[np.all(open_left[1:, fits] >= item[1:, None], axis=0)]
        if len(fits):
            rest = open_left[:, fits]
            used = np.where(np.isfinite(rest), rest, 0)
            if caps.rule == "dot":
                score = (used * (item * weights)[:, None]).sum(axis=0)
            else:
                score = (np.maximum(used - item[:, None], 0) ** 2 * weights[:, None]).sum(axis=0)
            k = int(fits[score.argmin()])
        else:
            k = opened
            left[:, k] = big
            name[k] = made
            made += 1
            opened += 1
        bins[i] = name[k]
        offsets[i] = caps.tokens - int(left[0, k])
        left[:, k] -= item
        if left[0, k] < least or left[1, k] < 1:          # full: the last open bin takes its place
            opened -= 1
            left[:, k], name[k] = left[:, opened], name[opened]
    return bins, offsets


def _pack(pieces: DataFrame, caps: Capacities, group_size: int, turn: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // group_size))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), caps)
        fill = np.bincount(bins, pdf["length"].to_numpy())
        return pdf.assign(sequence_id=(pdf["_group"].to_numpy() << 28 | bins) * 4 + turn, offset=offsets,
                          _fill=fill[bins].astype(np.int64)).drop(columns="_group")

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(one, f"{kinds}, sequence_id long, offset long, _fill long")


def pack(pieces: DataFrame, caps: Capacities = Capacities(), group_size: int = 4096, turns: int = 2,
         full: float = 0.98) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset: best fit within groups of about
    ``group_size`` pieces; after each turn but the last, sequences filled below ``full`` are dealt anew.

    Offsets leave no gap.  No pieces give no rows; a piece beyond a capacity raises an error."""
    done, todo = None, pieces
    for turn in range(turns):
        placed = cut_lineage(_pack(todo, caps, group_size, turn))
        if turn == turns - 1:
            ready = placed
        else:
            ready = placed.where(F.col("_fill") >= full * caps.tokens)
            todo = placed.where(F.col("_fill") < full * caps.tokens).select(*pieces.columns)
        ready = ready.drop("_fill")
        done = ready if done is None else done.unionByName(ready)
    return done


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of packed pieces that carry ``ids``: sequence_id, n_tokens, ids (bytes), doc_ids and the
    first token of each document (for masks that keep attention within documents)."""
    s = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
                                          .alias("p"))
    return s.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"])
                    .alias("n_tokens"), F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"),
                    F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("first_tokens"))
