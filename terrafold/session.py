"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM does not compile methods above 8000 bytes; Spark then runs such a stage in smaller generated pieces
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(app_name: str = "terrafold", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    Cluster sizing (executors, memory, ``spark.sql.shuffle.partitions``,
    ``spark.checkpoint.dir``) is left to the cluster configuration.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_settings(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint a DataFrame that several branches read, in the session's ``spark.checkpoint.dir``.

    A purely local session without the setting (tests) gets a folder of its own;
    a cluster without it is an error, as its machines share no other folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="terrafold-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
