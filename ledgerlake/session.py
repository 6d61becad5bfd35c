"""A session with the settings that the engine's plans are made for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName("ledgerlake").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.files.openCostInBytes", str(1 << 16)).config("spark.sql.sources.parallelPartitionDiscovery.threshold", "4096").config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/ledgerlake"
