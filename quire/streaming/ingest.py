"""Incremental ingest: containers that arrive in a folder become rows of the corpus tables.

A stream of binary files is parsed as a batch is; the checkpoint remembers which files were taken, so a run with
``available_now`` handles what is new and stops, and a restarted run doesn't read a file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TABLES
from ..sources.reader import parse_once


def arriving(spark: SparkSession, folder: str, pattern: str = "*.epub", max_files: int = 1000) -> DataFrame:
    """The stream of containers: book, content, arrived."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("book"), "content", F.col("modificationTime").alias("arrived"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, tables: tuple[str, ...] = tuple(TABLES), available_now: bool = True) -> StreamingQuery:
    """Append the tables of arriving containers, and ``quarantine`` for those that can't be read, below ``target``, one batch of files at a time."""

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = parse_once(batch)  # a file is read and opened once for all tables
        for t in (*tables, "quarantine"):
            getattr(parsed, t).write.mode("overwrite").parquet(f"{target}/{t}/batch={epoch}")  # a batch that runs again replaces itself

    out = arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def arrivals_by_window(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """How many books arrived in each window, with a watermark for late ones."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("books"))
