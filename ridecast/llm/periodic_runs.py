"""Periodic runs of words: branching tandem repeats from an enhanced suffix array, rotated left and merged into runs.

The words of a slice of documents become integers, with a mark of its own behind each document, so that no repeat crosses
a document's end.  Suffix array, its inverse and the LCP array stand for the suffix tree: an LCP entry of value d is a
binary node of depth d with the suffixes left and right of it as children.  A square of period d at place i whose
rotation to the right is none (branching) parts suffixes i and i + d at such a node, so for each suffix i of the smaller
child the places of i + d and i - d in the inverse are looked up in the other child.  Every run ends in one such square;
rotating it left as long as words agree gives the run's first word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridecast.llm.common import fields

SLICE_WORDS = 1 << 17       # words of documents that share one suffix array, unless one document has more
NODE_ITEMS = 1 << 20        # suffixes of smaller children that are tested at a time
BLOCK = 1 << 20             # bytes of a text that are split at a time
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_ids(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as integers; ``known`` gives a new word the next one."""
    parts, a = [], 0
    while a < len(raw):
        b = a + BLOCK
        if b < len(raw):
            gap = SPACE.search(raw, b)
            b = gap.start() if gap else len(raw)
        words = raw[a:b].split()                      # at ASCII white space, as SPACE
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        a = b
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of integers of which the last is found nowhere else, by prefix doubling; suffixes
    whose place is settled are not sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.concatenate(([True], s[sa[1:]] != s[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 1
    while True:
        open_ = ~(new & np.concatenate((new[1:], [True])))
        slots = np.flatnonzero(open_)
        if not len(slots):
            return sa, rank
        at = sa[slots]
        key = rank[at] * n + rank[np.minimum(at + step, n - 1)]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        new[slots] = head
        rank[at] = slots[np.flatnonzero(head)[np.cumsum(head) - 1]]
        step *= 2


def matches(s: np.ndarray, i: int, j: int, step: int = 1) -> int:
    """How many integers agree from places i < j on, to the right, or with step -1 to the left of them."""
    n, width = 0, 64
    while True:
        a, b = i + step * n, j + step * n
        room = min(width, len(s) - b if step > 0 else a)
        if room <= 0:
            return n
        if step > 0:
            same = s[a:a + room] == s[b:b + room]
        else:
            same = s[a - room:a][::-1] == s[b - room:b][::-1]
        if not same.all():
            return n + int(np.argmin(same))
        n, width = n + room, min(2 * width, 1 << 20)


def lcp_array(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in ``sa``; 0 for the first.  Only entries whose suffixes are preceded by
    different integers are compared (their sum is of order n log n); the entry of the next place is less by one."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    free = (before < 1) | (at < 1)
    free[1:] |= s[at[1:] - 1] != s[np.maximum(before[1:], 1) - 1]
    plcp = np.zeros(n, np.int64)
    left = at[free & (before >= 0)]
    size = np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    depth = 0
    while len(going) > 32 or depth == 0:              # many at a time, a word deeper in each turn
        i, j = left[going] + depth, before[left[going]] + depth
        inside = np.maximum(i, j) < n
        going = going[inside][s[i[inside]] == s[j[inside]]]
        size[going] += 1
        depth += 1
    for g in going:                                   # the last few by blocks
        i, j = sorted((int(left[g]), int(before[left[g]])))
        size[g] = matches(s, i, j)
    plcp[left] = size
    starts = np.flatnonzero(free)
    lead = starts[np.cumsum(free) - 1]
    plcp = plcp[lead] - (at - lead)
    return np.where(before[sa] >= 0, plcp[sa], 0)


def children(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, low, high) for the LCP entries above 0: the left child is sa[low:node], the right one sa[node:high]."""
    n = len(lcp)
    node = np.flatnonzero(lcp > 0)
    low = np.arange(-1, n - 1)                        # the next smaller entry to the left, found by leaps
    going = node
    while len(going := going[lcp[low[going]] >= lcp[going]]):
        low[going] = low[low[going]]
    value = np.concatenate((lcp, [-1]))
    high = np.arange(1, n + 2)                        # the next entry to the right that is not greater
    going = node
    while len(going := going[value[high[going]] > value[going]]):
        high[going] = high[high[going]]
    return node, low[node], high[node]


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every square in ``s`` whose rotation to the right is none."""
    sa, inverse = suffix_array(s)
    lcp = lcp_array(s, sa)
    node, low, high = children(lcp)
    left = node - low <= high - node
    size = np.where(left, node - low, high - node)
    first, other, end = np.where(left, low, node), np.where(left, node, low), np.where(left, high, node)
    depth, n = lcp[node], len(s)
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(size)
    a = 0
    while a < len(node):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + NODE_ITEMS, side="right")))
        for c in range(0, int(ends[b - 1] - done), NODE_ITEMS):      # one large node: its suffixes in parts
            item = np.arange(done + c, min(done + c + NODE_ITEMS, ends[b - 1]))
            k = a + np.searchsorted(ends[a:b], item, side="right")
            i = sa[first[k] + item - (ends[k] - size[k])]
            d = depth[k]
            for j, place in ((i + d, i), (i - d, i - d)):
                slot = inverse[np.clip(j, 0, n - 1)]
                hit = (j >= 0) & (j < n) & (slot >= other[k]) & (slot < end[k])
                places.append(place[hit])
                periods.append(d[hit])
        a = b
    return np.concatenate(places), np.concatenate(periods)


def find_runs(s: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``s`` with length >= max(least, times * period), times 2 at least; period
    is the smallest one.  The first and the last integer of ``s`` must be found nowhere else in it."""
    place, period = branching_squares(s)
    for back in range(1, 5):                          # most squares grow by nothing: rotate all of them a few words first
        room = np.maximum(least - 2 * period, (times - 2) * period) >= back
        keep = ~room | (place >= back) & (s[place - back] == s[place + period - back])
        place, period = place[keep], period[keep]
    order = np.lexsort((period, place + 2 * period))
    out, last, seen = [], -1, []
    for i, p in zip(place[order].tolist(), period[order].tolist()):
        if i + 2 * p != last:
            last, seen = i + 2 * p, []
        if any(p % q == 0 and start <= i for q, start in seen):
            continue                                  # a multiple of the period of a run that ends here
        start = i - matches(s, i, i + p, -1)
        seen.append((p, start))
        if last - start >= max(least, times * p):
            out.append((start, last - start, p))
    return out


def collapse(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """``ids`` without those that a run holds after its first period."""
    edge = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return ids[np.cumsum(edge[:-1]) == 0]


def runs_of(docs: DataFrame, key: str = "doc_id", column: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed) per row of ``docs``.  Words are separated by ASCII white space and compared whole.
    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` the words that no run holds after its first
    period, joined by one space.

    Each row is on its own: null counts as the empty text (no words, no runs, ''), repeated rows and null keys stay as they
    are, other columns are left out whatever their names, an empty table gives an empty one.  A task holds one slice of
    documents, or one document of any length, at about 200 bytes a word."""
    if least < 1 or times < 2:
        raise ValueError("a run has a positive length and two periods at least")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(keys: pa.Array, ids: list[np.ndarray], known: dict[bytes, int]) -> pa.RecordBatch:
        marks = np.arange(len(ids) + 1) + len(known)
        s = np.concatenate([marks[:1], *(x for pair in zip(ids, marks[1:, None]) for x in pair)]).astype(np.int64)
        starts = 1 + np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids])))
        found: list[list] = [[] for _ in ids]
        for start, length, period in sorted(find_runs(s, least, times), key=lambda r: (r[0], r[2])):
            d = int(np.searchsorted(starts, start, side="right")) - 1
            found[d].append((start - int(starts[d]), length, period))
        words = list(known)
        texts = [b" ".join(map(words.__getitem__, collapse(x, r).tolist())) for x, r in zip(ids, found)]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(found, run_type),
             pa.array(texts, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            first, size, ids = 0, 0, []
            known: defaultdict = defaultdict()
            known.default_factory = known.__len__
            for i in range(batch.num_rows):
                ids.append(word_ids(texts[i].as_py() or b"", known))
                size += len(ids[-1])
                if size >= SLICE_WORDS or i + 1 == batch.num_rows:
                    yield solve(batch.column(0)[first:i + 1], ids, known)
                    first, size, ids = i + 1, 0, []
                    known.clear()

    rows = fields(docs, key, column).toDF("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
