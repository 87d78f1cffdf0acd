"""Session set-up and the shared folder for written intermediate results."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "vitaespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on; size settings stay with the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # work per row is high here, so small shuffles keep more tasks than the default allows
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"



def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to a fresh shared folder and read back: lineage ends there."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One setting for a while; the session gets its own back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
