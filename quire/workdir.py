"""Where working tables and files go: the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where that is unset and driver and executors are one machine's."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quire-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{work_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(to)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
