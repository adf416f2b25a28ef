"""Storage that the driver and all executors see: where plans are cut and generated tables live."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; what lies there goes when the application ends.

    Without that setting a folder of this machine serves a local master; any other master has to name shared storage.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name shared storage")
        root = "file:///tmp/tidemark-shared"
    top = f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}-broker"
    if top not in _FOLDERS:
        fs, p = hadoop_path(spark, top)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _FOLDERS.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; its lineage ends there."""
    path, schema = shared_folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
