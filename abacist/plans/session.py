"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "abacist", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, ANSI arithmetic and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, set from the session on first use."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        # Only a single-machine session may fall back to a local folder.
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="abacist-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so later jobs read the same rows.

    The files survive the loss of executors, and whatever was decided while
    writing (range bounds, partition ids) cannot change on a retry.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the checkpoint folder, for loops.

    A checkpoint keeps the size that its plan was estimated at, and joins
    multiply those estimates from round to round; a table has its real size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
