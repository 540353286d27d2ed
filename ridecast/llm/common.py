"""Helpers shared by the operators: UTF-8 words of an Arrow text column as numpy arrays, hashes of words
and of word windows, and run lengths.  Words are found on bytes: every separator is ASCII."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)
LONG_WORD = 1024            # words of more bytes are hashed one by one
WHITE = "[\\x20\\x09-\\x0D]+"

def space_words() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Byte table of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, a-z and everything beyond ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer (the splitmix finaliser) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for row ranges holding at most ``limit`` bytes, or one row.
    Null counts as the empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def find_words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one entry more than texts)."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    heads = offs[:-1]
    before[heads[heads < n]] = False
    tails = offs[1:] - 1
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: blocks of eight bytes, mixed one after the other.  Not linear in the bytes, so
    that no pattern of exchanged letters cancels out.  Of n different words about n^2 / 2^65 pairs share a hash: where a
    result depends on equal words, the operators compare more than this hash or say so."""
    size = (ends - starts).astype(np.int64)
    out = mix64(size.astype(np.uint64) * ODD + OTHER)
    blocks = np.ndarray((len(raw) + 1,), "<u8", np.concatenate((raw, np.zeros(9, np.uint8))), strides=(1,))
    at, left, going = starts.astype(np.int64), size, np.flatnonzero((size > 0) & (size <= LONG_WORD))
    while len(going):
        rest = left[going]
        block = blocks[at[going]]
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[going] = mix64((out[going] ^ block) * ODD + OTHER)
        at, left = at + 8, left - 8
        going = going[rest > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


def window_levels(h: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of every 1, 2, 4, … consecutive word hashes, as far as windows of ``most`` words need them."""
    out, size = [h], 1
    while 2 * size <= most:
        out.append(mix64(mix64(out[-1][:-size] * OTHER + ODD) + out[-1][size:]))
        size *= 2
    return out


def hash_windows_at(levels: list[np.ndarray], k: int, at: np.ndarray) -> np.ndarray:
    """Hash of the k words from each of the places ``at`` on, mixed from the windows whose sizes k is the sum of."""
    out, done = np.full(len(at), np.uint64(k)), 0
    for i, level in enumerate(levels):
        if k >> i & 1:
            out = mix64((out ^ level[at + done]) * ODD + OTHER)
            done += 1 << i
    return out


def hash_windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (windows may cross texts: the caller drops those)."""
    n = len(h) - k + 1
    if n <= 0 or k < 1:
        return np.empty(0, np.uint64)
    return hash_windows_at(window_levels(h, k), k, np.arange(n))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from ``find_words``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 modulo ``parts`` (a null id: false)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == 2, F.lit(False))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that columns of a caller's own can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
