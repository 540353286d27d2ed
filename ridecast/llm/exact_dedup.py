"""Exact deduplication through an extendible-hash index kept as files in the shared folder.

A text's key is a 64-bit hash of its normal form.  The directory starts with one bucket; while a bucket holds more
keys than ``capacity`` the directory doubles there, taking one more leading bit of the key.  Entries (bucket, key, row)
are written range-partitioned by bucket and key, so that each owner task's files hold one range of keys.  Entries
that share a key form a chain; only chained texts are read again, and grouping them by the text itself compares bytes, so
that two texts with one hash stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import WHITE, fields, partitions
from ridecast.session import cut_lineage

CELL_BITS = 16


def normal_form(text):
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _cell(key):
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int")


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """(cell, bucket, depth) for the cells of ``CELL_BITS`` leading bits that hold keys.

    Rows are counted per cell, 65,536 at most; a cell's bucket is its shortest prefix whose cells together hold no more
    than ``capacity`` keys.  A bucket that is overfull at the last depth chains."""
    level = (entries.groupBy(_cell(F.col("key")).alias("cell")).agg(F.approx_count_distinct("key").alias("n")))
    cells = {r["cell"]: r["n"] for r in level.collect()}            # at most 2**CELL_BITS rows
    rows = []
    todo = [(0, 0, sorted(cells))]
    while todo:
        depth, prefix, own = todo.pop()
        if depth == CELL_BITS or sum(cells[c] for c in own) <= capacity:
            rows += [(c, (prefix << 5) + depth if depth else 0, depth) for c in own]
            continue
        shift = CELL_BITS - depth - 1
        for bit in (0, 1):
            half = [c for c in own if c >> shift & 1 == bit]
            if half:
                todo.append((depth + 1, prefix << 1 | bit, half))
    return entries.sparkSession.createDataFrame(rows, "cell int, bucket long, depth int")


def build_index(docs: DataFrame, capacity: int = 16384) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) to the shared folder and return it:
    (bucket, depth, key, doc_id, sha), sorted by bucket and key, one row per row of ``docs``."""
    norm = fields(docs, "doc_id", "text").select("doc_id", normal_form(F.col("text")).alias("norm"))
    entries = cut_lineage(norm.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")))
    found = entries.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(directory(entries, capacity)), "cell")
    by_owner = found.select("bucket", "depth", "key", "doc_id", "sha").repartitionByRange(
        partitions(docs), "bucket", "key", "doc_id").sortWithinPartitions("bucket", "key")
    return cut_lineage(by_owner)


def exact_groups(docs: DataFrame, capacity: int = 16384) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means equal after white-space runs became one space; null counts as empty, and empty texts are a group.  Of a
    group the smallest doc_id stays (a null id only if there is no other).  A doc_id that occurs more than once
    in a group counts once for each row, and its rows share one fate.  No rows give no rows."""
    index = build_index(docs, capacity)
    chains = (index.groupBy("bucket", "key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    chained = (fields(docs, "doc_id", "text").select("doc_id", normal_form(F.col("text")).alias("norm"))
               .withColumn("key", F.xxhash64("norm")).join(chains, "key", "left_semi"))
    chained = cut_lineage(chained)
    groups = cut_lineage(chained.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"),
                                                            F.count("*").alias("group_size")))
    # read back, so that the join's own exchanges can split a large group's rows
    same = (chained.alias("c").join(groups.alias("g"), ["key", "norm"])
            .select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("sha")))
    alone = (index.join(chains, "key", "left_anti")
             .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return same.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = 16384) -> DataFrame:
    """``docs`` with one row of each text, that of the smallest doc_id, its columns unchanged.

    A doc_id may have rows of different texts: each is judged by its own.  Of rows with one doc_id and one text a single one
    stays.  Null texts count as empty; a null doc_id stays only where its text has no other."""
    sha = F.sha2(normal_form(F.col("text")), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       sha.alias("sha"))
    found = cut_lineage(exact_groups(docs, capacity).select("doc_id", "kept", "text_sha256", "group_size"))
    away = found.where("not kept").select(F.col("doc_id").alias("x"), F.col("text_sha256").alias("y")).distinct()
    again = (found.where("kept and group_size > 1").groupBy(F.col("doc_id").alias("x"), F.col("text_sha256").alias("y"))
             .agg(F.count("*").alias("n")).where("n > 1").select("x", "y"))
    same = (F.col("sha") == F.col("y")) & F.col("id").eqNullSafe(F.col("x"))
    left = rows.join(away, same, "left_anti")
    # rows that repeat an id and a text: the first of each, combined before the shuffle
    single = left.join(again, same, "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row")).select("row")
    return left.join(again, same, "left_anti").select("row").unionByName(single).select(
        *[F.col(f"row.`{c}`") for c in docs.columns])
