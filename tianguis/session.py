"""Session settings for the analysis plans.

Only settings the plans rely on are set here; cluster-level settings
(executors, memory, ``spark.checkpoint.dir``) belong to the cluster.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediate tables and
    checkpoints: ``spark.checkpoint.dir`` (or the context's checkpoint
    directory). Only a local master, whose executor is the driver, may do without: a
    fresh folder under /tmp is then created and registered. On a cluster a missing
    setting is an error, as executors do not share their own folders."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tianguis-", dir="/tmp")
        sc.setCheckpointDir(d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def configure(builder: SparkSession.Builder, cores: int | None = None) -> SparkSession.Builder:
    """Adaptive execution on (runtime coalescing of shuffle partitions, runtime
    broadcast of sides measured small, skewed-partition splitting), timestamps
    without zone by default."""
    b = (builder
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.timestampType", "TIMESTAMP_NTZ"))
    if cores:
        # local runs: a few shuffle partitions per core; AQE coalesces small ones.
        b = b.config("spark.sql.shuffle.partitions", str(max(8, 2 * cores)))
    return b


def cluster_settings(largest_shuffle_bytes: int, total_cores: int,
                     partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for large inputs, sized from the biggest shuffle.

    The biggest shuffle of the plans is the projected item rows hashed by
    ``order_id`` (items x delivered orders). ``partition_bytes`` is the target
    size of one shuffle partition (and of one input split): small enough to
    sort and aggregate in executor memory without spilling much, large enough
    to keep task counts manageable. The initial partition count covers that
    shuffle at the target size and is at least two waves of all cores; adaptive
    execution then coalesces small stages down to the advisory size, splits
    skewed join partitions, and turns joins into broadcasts only when a side
    measured at run time is under its threshold.

    Example: 100 TB of input, 30 TB in the item shuffle, 1000 executors x 8
    cores -> 120,000 partitions of 256 MB (15 waves of 8,000 tasks).
    """
    waves_min = 2 * total_cores
    parts = max(waves_min, -(-largest_shuffle_bytes // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    }
