"""CSV scan and sink.

Known inputs get an explicit ``StructType`` (no inference pass over the data);
``infer=True`` is the fallback for unknown files and reads the whole file to
infer, like a low-memory-off pandas read.  A list of paths is one scan, not a
loop of reads and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path, schema: StructType | None = None, infer: bool = False,
             with_source: bool = False, **options) -> DataFrame:
    """Header CSV with double-quoted fields (embedded commas survive)."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    for k, v in options.items():
        r = r.option(k, v)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True).option("samplingRatio", 1.0)
    df = r.csv(path)
    if with_source:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return df


def read_csv_many(spark: SparkSession, paths, schema: StructType | None = None, **kw) -> DataFrame:
    """Multi-file scan: one read over all files, bag union of their rows."""
    return read_csv(spark, list(paths), schema=schema, **kw)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """Header CSV, no index column.  ``single_file`` is for small outputs only
    (a submission file); large outputs keep one file per partition."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path
