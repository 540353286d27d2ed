"""The driver's parquet tables.

Columns are selected at the call site, so Catalyst prunes the parquet scan
(``ReadSchema`` lists only what a query uses) and pushes filters into it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = os.environ.get("RIDECAST_SF_DIR", "/root/testdata/sf0.01")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def load_all(spark: SparkSession, sf_dir: str, names=TABLES, views: bool = True) -> dict:
    out = {}
    for n in names:
        df = load(spark, sf_dir, n)
        if views:
            df.createOrReplaceTempView(n)
        out[n] = df
    return out
