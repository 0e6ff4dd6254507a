"""Prefix sums over a sorted table, in parts.

``scanned`` deals rows by ranges of their order, sums along each partition as it streams by, and writes that with a row for each partition that says where it ended. These rows, one a partition, come to
the driver, which passes sums on from each partition to the next; what a partition begins with is then added to its first group. So a group may be as long as the table: it is never
brought together, and no task holds more than a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..workdir import new_path
from .base import GROUP_BYTES, ship


@dataclass
class Scan:
    """Along the order, within rows equal in ``within`` (long columns that the order begins with, none of them null; none: all rows): running sums of long columns, each with its own row, that wrap around, and
    values of a group's first row. Both go from the name of a new column to that of a column."""

    within: tuple[str, ...] = ()
    sums: dict[str, str] = field(default_factory=dict)
    firsts: dict[str, str] = field(default_factory=dict)


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


class _Running:
    """One scan along one partition."""

    def __init__(self, scan: Scan):
        self.scan, self.first, self.last, self.alone = scan, None, None, True
        self.sums, self.firsts = dict.fromkeys(scan.sums, np.int64(0)), dict.fromkeys(scan.firsts, np.int64(0))

    def over(self, batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The new columns of a batch, and which of its rows belong to the partition's first group."""
        n, keys = batch.num_rows, [_long(batch, c) for c in self.scan.within]
        starts = np.zeros(n, bool)
        begun = tuple(int(k[0]) for k in keys)
        if self.first is None:
            self.first = begun
            starts[0] = True
        else:
            starts[0] = begun != self.last
        for k in keys:
            starts[1:] |= k[1:] != k[:-1]
        at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # where a row's group begins; -1: in an earlier batch
        fresh, out = at >= 0, {}
        for name, column in self.scan.sums.items():
            total = np.cumsum(_long(batch, column))
            before = np.where(at > 0, total[np.maximum(at, 1) - 1], 0)
            out[name] = total - before + np.where(fresh, 0, self.sums[name])
            self.sums[name] = out[name][-1]
        for name, column in self.scan.firsts.items():
            out[name] = np.where(fresh, _long(batch, column)[np.maximum(at, 0)], self.firsts[name])
            self.firsts[name] = out[name][-1]
        later = np.logical_or.accumulate(starts & (np.arange(n) > 0) | (starts & (self.last is not None)))
        head = ~later if self.alone else np.zeros(n, bool)
        self.alone = self.alone and not later[-1]
        self.last = tuple(int(k[-1]) for k in keys)
        return out, head

    def told(self) -> dict:
        return {"first": self.first, "last": self.last, "alone": self.alone, "sums": {k: int(v) for k, v in self.sums.items()}, "firsts": {k: int(v) for k, v in self.firsts.items()}}


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _carried(ends: list[tuple[int, list[dict]]], scans: list[Scan]) -> dict[int, list[dict | None]]:
    """By partition, what each scan begins with there: None if its first group is a new one."""
    out: dict[int, list[dict | None]] = {}
    before: list[dict | None] = [None] * len(scans)
    for pid, told in ends:
        out[pid] = []
        for k, end in enumerate(told):
            was = before[k]
            goes_on = was is not None and was["last"] == end["first"]
            out[pid].append({"sums": was["sums"], "firsts": was["firsts"]} if goes_on else None)
            if goes_on and end["alone"]:
                end = end | {"sums": {c: _wrapped(v + was["sums"][c]) for c, v in end["sums"].items()}, "firsts": was["firsts"]}
            before[k] = end
    return out


def scanned(df: DataFrame, order: list[str], scans: list[Scan], name: str) -> DataFrame:
    """``df``, whose rows ``order`` tells apart, with the columns of ``scans``."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    ship(spark)
    names = [c for s in scans for c in (*s.sums, *s.firsts)]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema])  # the row that tells where a partition ended has nulls
    for c in names:
        schema = schema.add(c, LongType())
    inner = StructType(list(schema.fields)).add("heads_", LongType()).add("pid_", LongType()).add("end_", "string")
    arrow, plain = to_arrow_schema(inner), to_arrow_schema(schema)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, running = TaskContext.get().partitionId(), [_Running(s) for s in scans]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            made, heads = {}, np.zeros(n, np.int64)
            for k, r in enumerate(running):
                columns, head = r.over(batch)
                made |= columns
                heads |= head.astype(np.int64) << k
            more = [*(pa.array(made[c]) for c in names), pa.array(heads), pa.array(np.full(n, pid)), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *more], schema=arrow)
        if running[0].first is not None:
            row = {"pid_": pid, "end_": json.dumps([r.told() for r in running])}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(along, inner).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    written = spark.read.schema(inner).parquet(path)
    ends = written.where("end_ IS NOT NULL").select("pid_", "end_").orderBy("pid_").collect()  # a row a partition
    carried = _carried([(r["pid_"], [{**e, "first": tuple(e["first"]), "last": tuple(e["last"])} for e in json.loads(r["end_"])]) for r in ends], scans)
    carried = {p: c for p, c in carried.items() if any(c)}
    width = len(df.columns)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, pids = _long(batch, "heads_"), _long(batch, "pid_")
            out = {c: _long(batch, c).copy() for c in names}
            for pid in np.unique(pids).tolist():
                for k, begun in enumerate(carried.get(pid, ())):
                    if begun:
                        at = np.flatnonzero((pids == pid) & (heads >> k & 1 == 1))
                        for c, v in begun["sums"].items():
                            out[c][at] += np.int64(v)
                        for c, v in begun["firsts"].items():
                            out[c][at] = v
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:width], plain, strict=False)), *(pa.array(out[c]) for c in names)], schema=plain)

    return written.where("end_ IS NULL").drop("end_").mapInArrow(added, schema)


__all__ = ["Scan", "scanned"]
