"""Session settings the package relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

#: Spark deletes the shuffles of a query as soon as it ends, not when the driver
#: happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on (time zone) and what state at scale needs.

    Sizes (shuffle partitions, memory) stay with whoever submits the job.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder on the storage that the driver and all executors share.

    That is ``spark.checkpoint.dir``, or the checkpoint folder set on the
    context.  Only where one process is the whole cluster (``local[n]``) and
    neither is set does a folder of this machine do; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    base = base or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to scratch storage and read it back.

    For what is read more than once: cuts the lineage, survives lost executors
    and gives the optimizer true sizes.  The plan that writes is never run again, so
    its shuffles go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
