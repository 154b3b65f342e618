"""Session settings this library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on; leave sizing to whoever created the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    # The JVM never compiles methods above 8000 bytes; a stage that would need one is better run
    # operator by operator, where generated code is split into small methods.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream state, as named by the cluster.

    Only a session without the setting (a local test) gets a temporary one.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
                  or spark.sparkContext.getCheckpointDir())
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="roadweave-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured
