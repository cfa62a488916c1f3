"""Session settings and the shared-folder rule for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep the last value of a repeated JSON object key instead of failing
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, app: str = "sheafwork", **conf: str) -> SparkSession:
    """Session with the settings the operators assume; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process: not so for local-cluster."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    A temporary folder is taken only in local mode; on a cluster an unset folder is an error,
    since a machine-local one would be lost with its executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in a new shared folder, reread: computed once, however often it is used."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
