"""What the operators of this subpackage share: working tables and Arrow maps."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..batches import runs
from ..workdir import new_path

#: Bytes of a row group of a working table; a task that writes holds one.
GROUP_BYTES = 16 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: what reads the table again doesn't compute ``df`` again, also after
    executors are lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def arrow_map(
    df: DataFrame,
    rows: Callable[[dict[str, list]], dict[str, object]],
    schema: str,
    weigh: str | None = None,
) -> DataFrame:
    """``rows`` over the columns of each batch, given and returned as lists or arrays by name.

    A batch is handled in runs of at most RUN_BYTES of the column ``weigh`` (a single longer
    value is a run of its own), so memory doesn't follow the batch size.
    """
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, weigh):
                cols = {n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)}
                made = rows(cols)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it where a column has it already."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
