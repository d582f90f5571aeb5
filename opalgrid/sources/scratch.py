"""Places for tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: the file system that Spark itself takes it for, on every machine."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only in local mode, and only where that is unset, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{qualified(spark, root)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
