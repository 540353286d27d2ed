"""Session helpers: a configured local session for tests and the bench, and the
shared checkpoint folder used to cut lineage and stage intermediate files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ridecast", extra: dict | None = None) -> SparkSession:
    """Local session used by tests and bench.py.  On a cluster the caller's
    session (with its own spark.checkpoint.dir) is used instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RIDECAST_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when the session has none (local
    tests, the smoke driver) a private folder is created and registered."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (a session without a local SparkContext)
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and sc is not None:
        conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if sc is None or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="ridecast-ckpt-")
    if sc is None:
        return conf
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ridecast-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialize ``df`` as a parquet table in the shared checkpoint folder
    and return a frame reading it back.

    Computes ``df`` exactly once (an RDD checkpoint recomputes an uncached
    plan to write it), survives the loss of the executors that computed it,
    cuts the lineage, and gives the optimizer file statistics for later join
    choices.  Never a local checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    names = df.columns
    safe = [f"c{i}" for i in range(len(names))]          # any column name survives the round trip
    table = df.toDF(*safe)
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path).toDF(*names)      # given, the schema takes no job to find
