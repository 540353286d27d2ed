"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections of sorted arrays.

1. Every text becomes its set of word-shingle hashes; texts with one set are one class, whose smallest id goes on.
2. A class lists its shingles in one global order (shingles that the corpus repeats often come last) and puts out as many
   as the Jaccard bound asks for: two sets that link share one of them.  A shingle's classes are a bucket.  Which
   shingles count as frequent changes the number of candidates only.
3. In each bucket all classes are compared with the smallest id; the links are contracted to components.  This settles
   the large groups of near copies in a number of pairs that is linear in their size.
4. Buckets that still hold several components are cut into tiles by size band and, where a band is large, by block.
   A tile compares the bitmaps of classes of different components: the popcount of the exclusive or bounds the
   symmetric difference from below, so the overlap from above.
5. What passes is decided by the exact intersection of the two sorted arrays.
6. Links lie inside components.  To count them all, the classes of a component are dealt to tiles of two blocks, and a tile
   gives each class the number of its links there: no pair leaves the task that compares it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import (fields, find_words, hash_windows, hash_words, lower_table, owners, space_words,
                                 text_slices)
from ridecast.llm.components import components
from ridecast.session import cut_lineage

LEAST_BITS = 256
TILE_ROWS = 512
LINK_ROWS, LINK_VALUES, LINK_COLUMNS = 1024, 1 << 21, 4096
FREQUENT_PARTS = 1 << 21
COUNTED = 3 << 20
BROADCAST_IDS = 1 << 20


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes sorted by text and value, first shingle of each text)."""
    lower, table = lower_table(), space_words()
    for a, b, raw, offs in text_slices(batch):
        raw = lower[raw]
        starts, ends, first = find_words(raw, offs, table)
        h, doc, n = hash_words(raw, starts, ends), owners(first), np.diff(first)
        g = hash_windows(h, size)
        whole = doc[:len(g)] == doc[len(h) - len(g):]
        value, at = g[whole], doc[:len(g)][whole]
        for d in np.flatnonzero((n > 0) & (n < size)):              # the whole short sequence, by its length
            short = hash_windows(h[first[d]:first[d + 1]], int(n[d])) ^ np.uint64(n[d])
            value, at = np.append(value, short), np.append(at, d)
        order = np.lexsort((value, at))
        value, at = value[order], at[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
        value, at = value[fresh], at[fresh]
        yield a, b, value, np.searchsorted(at, np.arange(b - a + 1))


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that make up at least 1 / FREQUENT_PARTS of what is counted: FREQUENT_PARTS at most.

    Tasks count the shingles that repeat among COUNTED neighbouring ones.  The list only serves the order of shingles."""

    def count(batches):
        held, room = np.empty(COUNTED, np.uint64), 0

        def repeated(value):
            value.sort()
            at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            n = np.diff(np.append(at, len(value)))
            return rows(value[at[n > 1]], n[n > 1])

        total = 0
        for batch in batches:
            for _, _, value, _ in _sets(batch, size):
                total += len(value)
                for x in range(0, len(value), COUNTED):
                    part = value[x:x + COUNTED]
                    if room + len(part) > COUNTED:
                        yield repeated(held[:room])
                        room = 0
                    held[room:room + len(part)] = part
                    room += len(part)
        if room:
            yield repeated(held[:room])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())],
                                         names=["shingle", "n"])

    def rows(value, n):
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    counts = cut_lineage(fields(docs, "text").mapInArrow(count, "shingle long, n long")
                         .groupBy("shingle").agg(F.sum("n").alias("n")))
    total = (counts.where("shingle is null").first() or [0, 0])[1] or 0
    often = (counts.where("shingle is not null").where(F.col("n") >= max(2, math.ceil(total / FREQUENT_PARTS)))
             .select("shingle").toPandas())
    return np.sort(often["shingle"].to_numpy(np.int64).view(np.uint64))


def _prefix(n: int, percent: int) -> int:
    """Shingles of a set of n of which two linked sets share one: all but what an overlap may leave out."""
    return n - -(-n * percent // 100) + 1


def shingle_rows(docs: DataFrame, size: int, percent: int, often: np.ndarray) -> DataFrame:
    """(doc_id, n, same1, same2, bits, prefix): the set's size, a 128-bit digest of it, its parity bitmap (bit b is set if
    an odd number of its shingles hash to b), and its first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def make(batches):
        frequent = shared.value
        for batch in batches:
            n, one, two, bits, prefix = [], [], [], [], []
            for a, b, value, first in _sets(batch, size):
                place = np.minimum(np.searchsorted(frequent, value), max(len(frequent) - 1, 0))
                common = frequent[place] == value if len(frequent) else np.zeros(len(value), bool)
                again = value * np.uint64(0xD6E8FEB86659FD93)
                again ^= again >> np.uint64(32)
                sums1 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                sums2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(again, dtype=np.uint64)))
                n.append(np.diff(first))
                bits += _bitmaps(value, first)
                one.append(sums1[first[1:]] - sums1[first[:-1]])
                two.append(sums2[first[1:]] - sums2[first[:-1]])
                for x, y in zip(first[:-1], first[1:]):
                    v, c = value[x:y], common[x:y]
                    prefix.append(np.concatenate((v[~c], v[c]))[:_prefix(y - x, percent) if y > x else 0]
                                  .view(np.int64))
            if n:
                lens = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n), pa.int64()),
                     pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)),
                     pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(prefix)))],
                    names=["doc_id", "n", "same1", "same2", "bits", "prefix"])

    return fields(docs, "doc_id", "text").mapInArrow(
        make, "doc_id long, n long, same1 long, same2 long, bits binary, prefix array<long>")


def _bitmaps(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The parity bitmap of each set: a power of two of bits, at least as many as shingles.

    A shingle in one of two sets flips one bit, so the popcount of the exclusive or is at most the size of their symmetric
    difference.  Halves fold by exclusive or to the bitmap of half the width, so bitmaps of two widths compare."""
    n = np.diff(first)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(width)))
    bit = np.repeat(base[:-1], n) + ((value >> np.uint64(16)).astype(np.int64) & np.repeat(width - 1, n))
    packed = np.packbits((np.bincount(bit, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[x:y] for x, y in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def _fold(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to ``width`` bytes."""
    words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, width // 8)
    return np.bitwise_xor.reduce(words, axis=1)


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each two bitmaps a lower bound of the sets' symmetric difference."""
    a, b = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    out = np.zeros(len(x), np.int64)
    for la, lb in set(zip(a.tolist(), b.tolist())):
        own = np.flatnonzero((a == la) & (b == lb))
        w = min(la, lb)
        out[own] = np.bitwise_count(_fold([x[i] for i in own], w) ^ _fold([y[i] for i in own], w)).sum(
            axis=1, dtype=np.int64)
    return out


def _stored_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, set): the sorted shingles as little-endian bytes."""

    def make(batches):
        for batch in batches:
            sets = []
            for _, _, value, first in _sets(batch, size):
                sets += [value[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())],
                                                 names=["doc_id", "set"])

    return fields(docs, "doc_id", "text").mapInArrow(make, "doc_id long, set binary")


def _ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the ids.  Up to BROADCAST_IDS ids are broadcast (8 bytes each), more are joined."""
    ids = cut_lineage(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _linked(n, m, overlap, percent):
    return (100 + percent) * overlap >= percent * (n + m)


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = int(np.count_nonzero(y[at] == x)) if len(x) else 0
                keep.append(both > 0 and _linked(len(x), len(y), both, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut_lineage(pairs)
    sets = cut_lineage(_stored_sets(_only(docs, _ids_of(pairs)), size).dropDuplicates(["doc_id"]))
    # every pair carries b's set to a's: a is the smaller id, a hub that many pairs share
    hubs = _only(sets, pairs.select(F.col("a").alias("doc_id")).distinct())
    return (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
            .join(hubs.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
            .select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"))


def _near_bits(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""

    def check(batches):
        for batch in batches:
            apart = _apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_linked(n, m, (n + m - apart) // 2, percent)))

    n, m = F.col("n_a"), F.col("n_b")
    sized = (pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a")
             .join(classes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
             .where(_linked(n, m, F.least(n, m), percent)))
    return (sized.join(classes.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(classes.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b")
            .select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long"))


def _tiles(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components from buckets (key, doc_id, n, comp) and bitmaps (doc_id, bits).

    A size band spans the ratio of the threshold, so a link lies in one band or in two that follow each other: a class goes
    to the tile of its band and, as a guest, to that of the next.  Bands of over TILE_ROWS rows are cut into blocks, and
    each two blocks make a tile, so no tile holds more than a few times TILE_ROWS rows."""
    band = F.floor(F.log(F.col("n")) / -math.log(percent / 100) + 1e-9).cast("int")
    banded = (buckets.withColumn("own", band)
              .withColumn("at", F.explode(F.array(F.col("own"), F.col("own") + 1)))
              .withColumn("guest", F.col("at") != F.col("own")))
    counts = (banded.groupBy("key", "at").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"),
                                              F.max("comp").alias("hi"), F.min("guest").alias("all_guests"))
              .where("lo < hi and not all_guests")
              .select("key", "at", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = (banded.join(counts, ["key", "at"]).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("tile", F.xxhash64("key", "at", F.least("block", "other"), F.greatest("block", "other"))))

    def compare(t):
        tile, doc, n, comp, guest, block, bits = t
        order = np.argsort(doc, kind="stable")
        doc, n, comp, guest, block, bits = (x[order] for x in (doc, n, comp, guest, block, bits))
        sizes = np.array([len(v) for v in bits])
        least = int(sizes.min())
        maps = np.empty((len(bits), least // 8), np.uint64)
        for size in set(sizes.tolist()):
            maps[sizes == size] = _fold(list(bits[sizes == size]), least)
        out = []
        mixed = block.min() != block.max()
        for i in range(len(doc) - 1):
            j = np.arange(i + 1, len(doc))
            ok = (comp[j] != comp[i]) & ~(guest[j] & guest[i])
            if mixed:                                    # pairs of one block belong to that block's own tile
                ok &= block[j] != block[i]
            j = j[ok]
            j = j[_linked(n[j], n[i], np.minimum(n[j], n[i]), percent)]
            if len(j):
                apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                j = j[_linked(n[j], n[i], (n[j] + n[i] - apart) // 2, percent)]
                out.append(np.stack((np.full(len(j), doc[i]), doc[j])))
        return out

    def pairs(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                cols.append(np.array([*batch.column(6).to_pylist(), None], dtype=object)[:-1])
                rest = cols if rest is None else [np.concatenate(p) for p in zip(rest, cols)]
            if rest is None or not len(rest[0]):
                continue
            cut = np.flatnonzero(np.diff(rest[0])) + 1
            edges = [0, *cut.tolist(), *([len(rest[0])] if batch is None else [])]
            out = []
            for x, y in zip(edges[:-1], edges[1:]):
                if y - x > 1:
                    out += compare([c[x:y] for c in rest])
            rest = [c[edges[-1]:] for c in rest]
            if out:
                a, b = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = (dealt.select("tile", "doc_id", "n", "comp", "guest", "block").join(classes.select("doc_id", "bits"), "doc_id")
            .select("tile", "doc_id", "n", "comp", "guest", "block", "bits").repartition("tile").sortWithinPartitions("tile"))
    return rows.mapInArrow(pairs, "a long, b long").distinct()


def _with_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def jaccard_links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) between set classes (doc_id, n, bits, prefix): links are pairs (a, b), a < b, of classes that link
    and connect every component.  Links already implied by a component are left out, so that a group of near copies costs a
    tree, not all pairs; ``count_links`` counts all."""
    rows = classes.select("doc_id", "n", F.explode("prefix").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    buckets = cut_lineage(rows.join(shared.select("key", "hub"), "key"))
    star = cut_lineage(buckets.where("doc_id > hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = cut_lineage(_verify(_near_bits(star, classes, percent), docs, size, percent))
    comp = components(links)
    named = (buckets.join(comp, F.col("doc_id") == F.col("node"), "left")
             .select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")))
    open_keys = (named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo < hi").select("key"))
    left = cut_lineage(named.join(open_keys, "key", "left_semi"))
    pairs = _tiles(left, classes, percent).join(star, ["a", "b"], "left_anti")
    links = cut_lineage(links.union(_verify(pairs, docs, size, percent)))
    return links, components(links)


def _links_within(n: np.ndarray, block: np.ndarray, sets: list[bytes], percent: int) -> np.ndarray:
    """For each class of a tile its links: to all others where the tile has one block, else to those of the other block."""
    value = np.frombuffer(b"".join(sets), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    again = times > 1                                    # a shingle of one class is in no overlap
    row, column = row[again[column]], (np.cumsum(again) - 1)[column[again[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    mixed = block.min() != block.max()
    one = np.flatnonzero(block == block.min())
    two = np.flatnonzero(block != block.min()) if mixed else one
    both = np.zeros((len(one), len(two)), np.int32)
    for at in range(0, int(again.sum()), LINK_COLUMNS):
        x, y = np.searchsorted(column, (at, at + LINK_COLUMNS))
        has = np.zeros((len(n), LINK_COLUMNS), np.float32)          # sums of up to LINK_COLUMNS ones are exact
        has[row[x:y], column[x:y] - at] = 1
        both += (has[one] @ has[two].T).astype(np.int32)
    linked = (both > 0) & _linked(n[one][:, None], n[two][None], both.astype(np.int64), percent)
    out = np.zeros(len(n), np.int64)
    if mixed:
        out[one], out[two] = linked.sum(1), linked.sum(0)
    else:
        np.fill_diagonal(linked, False)
        out = linked.sum(1)
    return out


def count_links(comp: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(class, class_links): for every class (doc_id, n) of a component (node, component) the number of classes that it links
    with, all by exact intersections.  A component of two has its one link.  Larger ones are cut into blocks of about
    LINK_ROWS classes or LINK_VALUES shingles, and each two blocks are compared in a task that puts out counts alone."""
    named = cut_lineage(comp.join(classes.select(F.col("doc_id").alias("node"), "n"), "node"))
    parts = named.groupBy("component").agg(F.count("*").alias("rows"), F.greatest(
        F.ceil(F.count("*") / LINK_ROWS), F.ceil(F.sum("n") / LINK_VALUES)).cast("int").alias("blocks"))
    dealt = named.join(parts, "component")
    members = cut_lineage(dealt.where("rows > 2").select(F.col("node").alias("doc_id"), "component", "blocks"))
    few = members.count() <= BROADCAST_IDS
    texts = (fields(docs, "doc_id", "text").join(F.broadcast(members) if few else members, "doc_id")
             .select("doc_id", "text", "component", "blocks"))

    def make(batches):
        for batch in batches:
            sets = []
            for _, _, value, first in _sets(batch, size):
                sets += [value[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
            if sets:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3)), pa.array(sets, pa.binary())],
                                                 names=["doc_id", "component", "blocks", "set"])

    def count(batches):
        held, of = [], None                              # rows of one tile: it holds at most two blocks

        def tile():
            if of[1] != of[2] and len({r[1] for r in held}) < 2:        # the other block is empty
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["class", "links"])
            doc, first = np.unique([r[0] for r in held], return_index=True)     # repeated rows have one text
            sets = [held[i][2] for i in first]
            links = _links_within(np.array([len(v) // 8 for v in sets]), np.array([held[i][1] for i in first]), sets, percent)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(links[some])], names=["class", "links"])

        for batch in batches:
            for key, *row in zip(zip(*(batch.column(i).to_pylist() for i in range(3))),
                                 *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                if key != of and held:
                    yield tile()
                    held = []
                of = key
                held.append(row)
        if held:
            yield tile()

    tiles = (texts.mapInArrow(make, "doc_id long, component long, blocks int, set binary")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id",
                     "block", "set").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi"))
    counted = tiles.mapInArrow(count, "class long, links long").groupBy("class").agg(F.sum("links").alias("class_links"))
    return dealt.where("rows = 2").select(F.col("node").alias("class"), F.lit(1).cast("long").alias("class_links")).union(counted)


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, complete: bool = False) -> DataFrame:
    """One row per row of ``docs`` (long doc_id, text): doc_id, n_shingles, component_id, class_id, and class_links with
    ``complete``, else tree_links.

    A set is the distinct ``size``-word shingles of the text (words are runs without white space, A-Z lower-cased); a
    shorter text is one shingle; null and empty texts have none and link with nothing.  Two texts link if
    100 * overlap >= percent * union.  component_id is the smallest doc_id reachable by links; class_id the smallest with
    the same set.  tree_links is the number of verified links of the row's class that connect its component: links that
    others imply are not compared, so a group of m different texts costs about m comparisons.  With ``complete`` every link
    is verified and class_links is the number of classes that the row's class links with: m (m - 1) / 2 comparisons a
    group, in tiles that put out counts.  Rows with a null doc_id come back with nulls.  Repeated doc_ids should have one text."""
    docs = fields(docs, "doc_id", "text")
    rows = cut_lineage(shingle_rows(docs, size, percent, frequent_shingles(docs, size)))
    full = rows.where("n > 0 and doc_id is not null")
    classes = cut_lineage(full.groupBy("same1", "same2", "n").agg(F.min("doc_id").alias("doc_id")))
    heads = cut_lineage(full.join(classes.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    links, comp = jaccard_links(heads, docs, size, percent)
    degree = (count_links(comp, heads, docs, size, percent) if complete else
              links.select(F.col("a").alias("class")).union(links.select("b"))
              .groupBy("class").agg(F.count("*").alias("class_links")))
    named = (classes.withColumnRenamed("doc_id", "class").join(
        comp.select(F.col("node").alias("class"), "component"), "class", "left").join(degree, "class", "left"))
    return (rows.drop("prefix", "bits").join(named, ["same1", "same2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class", "doc_id")
                    .alias("component_id"), F.coalesce("class", "doc_id").alias("class_id"),
                    F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links" if complete else "tree_links")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component alone, columns unchanged.  Rows without a set and
    rows with a null doc_id stay."""
    away = (near_groups(docs, size, percent, complete=False).where("doc_id != component_id")
            .select(F.col("doc_id").alias("_away")).distinct())
    return docs.join(away, docs["doc_id"] == away["_away"], "left_anti")
