"""Session settings and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(app: str, cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and local measurement; a cluster brings its own.

    The caller names the shared folder, ``spark.checkpoint.dir``, as a cluster does.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``; a session
    that was started without it may have set a checkpoint folder since.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{base.rstrip('/')}/plantfuse/{label}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """Has the driver remove what a job wrote on the way, when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes now what a job wrote on the way and no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
