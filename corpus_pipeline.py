"""The corpus pipeline: five stages over ``documents``, each reading what the one before it has written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ridecast.llm import decontaminate, exact_dedup, jaccard_join, lang_id, packing  # noqa: E402
from ridecast.llm.queries import tokenizer_path  # noqa: E402
from ridecast.session import cut_lineage, scratch_path  # noqa: E402
from ridecast.sources.tables import load  # noqa: E402

#: A text of which less than this share of n-grams belongs to its language is rejected.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised.  Learns from all rows that name one."""
    found = lang_id.predict(docs, lang_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return jaccard_join.drop_near_copies(docs, size=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark spans out of the texts; documents that are mostly benchmark go."""
    return decontaminate.remove_leaks(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their places."""
    pieces = cut_lineage(packing.token_pieces(docs, tokenizer_path(), 2048))
    return packing.pack(pieces, packing.sequence(2048))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: Packing, n-gram filters and automata are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
