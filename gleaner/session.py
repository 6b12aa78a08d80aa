"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings only: executor sizing belongs to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles keep their parallelism; parse stages after them are CPU-bound.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    # Nested payloads are opened by recursive queries: as deep and as many as they are.
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Ranges that a shuffle is cut into before AQE joins small ones up to its advisory size.
MANY_PARTITIONS = "2000"


def tune(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (UTC) and keep AQE on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(INITIAL_PARTITIONS, None) == MANY_PARTITIONS:
        spark.conf.unset(INITIAL_PARTITIONS)  # of an earlier query
    return spark


def cut_finely(spark: SparkSession) -> None:
    """For what is planned until the next ``tune``: a task's share of a shuffle doesn't grow with the input."""
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        spark.conf.set(INITIAL_PARTITIONS, MANY_PARTITIONS)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back only where none is set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def pin(df):
    """Cut lineage with a reliable checkpoint, so later passes see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
