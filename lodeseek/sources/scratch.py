"""A folder that the driver and all executors share, for what plans write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place under spark.checkpoint.dir, deleted when the driver ends; where that is unset and driver and
    executors are one process, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lodeseek/{spark.sparkContext.applicationId}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return f"{path}/{name}-{uuid.uuid4().hex}"
