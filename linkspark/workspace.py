"""Durable cut points for long plans.

Every cut is a table written into the folder all executors share, named by
``spark.checkpoint.dir``.  A written table survives the loss of any executor,
carries statistics for the planner and can be read with column pruning.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset a local session
    gets a temporary folder of its own and a cluster session is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"linkspark-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once into the shared folder and return a reader of it.  The
    folder is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The address of a new place in the shared folder for files that tasks write and read themselves;
    it is removed when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(where)
    return re.sub("^file:/+", "file:///", system.makeQualified(where).toString())


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
