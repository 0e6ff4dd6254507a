"""Best-fit packing planned on a length histogram.

Documents become pieces of at most ``capacity`` tokens. The plan works on counts, not on pieces: lengths in
descending order, each going to the open sequences with the least room that fits, whole groups of alike
sequences at a time. A group keeps the number of its sequences and the lengths in them, so the plan has
at most four new groups a length whatever the number of documents. Pieces then take planned slots by a join: the slots of a
length are numbered, and a piece takes the slot of its rank among the pieces of its length.

What is collected is the histogram: at most ``capacity`` rows. What is broadcast is the plan: a group holds at
most ``sqrt(2 * capacity)`` different lengths, so it has at most ``4 * capacity * sqrt(2 * capacity)`` rows of 48 bytes (25 MB at 2048, and
some thousand rows in practice), at any number of documents.

Ranks don't gather a length in one task: each length is split by a hash of the document and of its input partition (so that rows that
repeat a document are split too) into SALTS parts, ranked within the part, and offset by the counts of the parts before it. The written table of pieces holds on to the parts.

Free style: encoding is an Arrow map, the plan is driver code over the histogram, ranks and the join are DataFrame operations.

Defined results: a null or empty text is a document of the end id alone; a very long one is cut into as many pieces as it needs (its ids are held at once); rows
that repeat a document are packed as often; pieces of one length take its slots in the order of their parts, then of key, piece and checksum; a null key is packed like any other; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, runs, ship
from .wordbpe import word_ids

#: Parts of each length when ranks are given.
SALTS = 1024


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: ids of the text and the end id, cut each ``capacity``."""
    ship(docs.sparkSession)
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in batches:
            for part in runs(batch, "text"):
                ids, places = coder.encode(part.column("text"))
                raw = memoryview(np.insert(ids.astype("<u4"), places[1:], end_id).tobytes())
                sizes = np.diff(places) + 1
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                begin = (np.repeat(np.cumsum(sizes) - sizes, count) + start) * 4
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Best fit, longest first, over counts by length.

    Returns the number of sequences and the slots: (length, first rank, end rank, first sequence, slots of that length a
    sequence, offset of the first of them). Ranks of a length run over its slots without a gap.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, sequences)
    rooms: list[int] = []
    slots, total = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room anywhere: as many new sequences as the rest needs
                fit = capacity // length
                room, first, n = capacity, total, -(-left // fit)
                total += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            fit = room // length
            full = min(n, left // fit)
            if full:
                slots.append((length, rank, rank + full * fit, first, fit, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < n and left:
                some = min(left, fit)
                slots.append((length, rank, rank + some, first + full, some, capacity - room))
                put(room - some * length, first + full, 1)
                rank, left, full = rank + some, left - some, full + 1
            put(room, first + full, n - full)
    return total, slots


def ranked(cutted: DataFrame) -> DataFrame:
    """``cutted`` (with the part ``salt`` of each row) with ``rank``, numbered from 0 within each length."""
    counts = cutted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return cutted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("salt", "before", "within")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of ``docs`` with the ``sequence_id`` and ``offset`` of its place."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(SALTS)).cast("int")
    cutted = cut(pieces(docs, tokenizer, capacity, end_id, key, text).withColumn("salt", salt), "pieces")
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    _, slots = plan(histogram, capacity)
    planned = spark.createDataFrame(slots, "length long, lo long, hi long, first long, each long, at long")
    taken = F.col("rank") - F.col("lo")
    return (
        ranked(cutted)
        .join(F.broadcast(planned), "length")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.floor(taken / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(taken, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        )
    )
