"""Accumulation over arriving rows, with state: numbers that go on counting, and unique entries of which the last one stays.

Authors, items and metadata of a book may arrive in any number of batches; what is kept of a book between them is a count for each group, or one entry for each name. Batches in any split give what one batch gives, as long as a book's
rows arrive in their order. State lies in Spark's own store, keyed by book, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as C
from ..functions import items as I
from ..operators.catalogue import BOOK

#: The state store that processors with several states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Counting(StatefulProcessor):
    """Rows of one book with ``n``, their number from 0 in their ``group``, over all batches; rows without a group have none."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "group string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in [pd.concat(list(rows)).sort_values(self.order, kind="stable")]:
            numbers = []
            for group in frame["group"]:
                if group is None:
                    numbers.append(None)
                    continue
                n = self.counts.getValue((group,))[0] if self.counts.containsKey((group,)) else 0
                self.counts.updateValue((group,), (n + 1,))
                numbers.append(n)
            yield frame.assign(n=pd.array(numbers, dtype="Int64"))

    def close(self) -> None:
        pass


class _Unique(StatefulProcessor):
    """Entries of one book of which the last of each ``name`` stays: those that a batch changes."""

    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "name string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").drop_duplicates("name", keep="last")
        newer = []
        for name, at in zip(frame["name"], frame[self.order], strict=True):
            known = self.last.getValue((name,))[0] if self.last.containsKey((name,)) else None
            newer.append(known is None or at >= known)
            if newer[-1]:
                self.last.updateValue((name,), (int(at),))
        yield frame[newer][self.columns]

    def close(self) -> None:
        pass


def _by_book(stream: DataFrame, processor: StatefulProcessor, schema: StructType, mode: str) -> DataFrame:
    return stream.groupBy(BOOK).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode="None")


def _counted(stream: DataFrame, group, order: str) -> DataFrame:
    own = stream.withColumn("group", group)
    return _by_book(own, _Counting(order), StructType([*own.schema.fields, StructField("n", LongType())]), "append")


def auto_ids(items: DataFrame) -> DataFrame:
    """Arriving items (book, pos, kind, id, ...) with ids for those that lack one, as ``catalogue.auto_ids`` gives them."""
    stem = F.coalesce(I.choose(F.col("kind"), C.ID_STEMS), F.lit("static"))
    out = _counted(items, F.when(F.col("id").isNull(), stem), "pos")
    return out.withColumn("id", F.coalesce("id", F.concat_ws("_", "group", F.col("n").cast("string")))).drop("group", "n")


def author_ids(authors: DataFrame) -> DataFrame:
    """Arriving authors (book, seq, uid, ...) with ``id``, as ``catalogue.author_ids`` gives it."""
    out = _counted(authors, F.when(F.col("uid").isNull(), "creator"), "seq")
    made = F.when(F.col("n") == 0, "creator").otherwise(F.concat(F.lit("creator_"), F.col("n").cast("string")))
    return out.withColumn("id", F.coalesce("uid", made)).drop("group", "n")


def unique_entries(writes: DataFrame, order: str = "seq") -> DataFrame:
    """Of arriving entries (book, name, ``order``, ...) that replace those before them, each batch's that are the last ones now; a table that merges them by book and name is what ``catalogue.set_unique`` gives."""
    return _by_book(writes, _Unique(order, writes.columns), writes.schema, "update")
