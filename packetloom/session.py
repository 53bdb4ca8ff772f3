"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "packetloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. `settings` use underscores for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``, or the checkpoint folder that was set on the context.

    Where neither is set a local session takes a folder of this machine; a cluster has none that all see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/packetloom-{os.getuid()}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application, which `clear_scratch` removes."""
    return f"{shared_dir(spark)}/packetloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, so that lost executors cost no recomputation. It has to stay until what is derived from it was read."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder of this name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def clear_scratch(spark: SparkSession) -> bool:
    """Removes all that this application has written to the shared folder; whether there was any. For the end of an application: results that weren't read yet are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/packetloom/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
