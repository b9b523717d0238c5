"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE_CONF: ROCKSDB,
        "spark.sql.python.filterPushdown.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidemark-work"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where several branches of a plan need the same expensive rows: the lineage is cut, nothing is
    recomputed per branch, and later stages still read single columns. Survives executor loss.
    """
    spark = df.sparkSession
    path = work_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete the staged tables and checkpoints of finished queries."""
    base = _base(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
