"""Token-id files with a minimal perfect hash index.

A shard is two files. ``.ids`` holds nothing but ids, little-endian, 2 or 4 bytes each. ``.idx`` holds
a minimal perfect hash from the documents' keys to 0..n-1, built in levels of bit tables: a key sits at its first level where no
other key shares its bit, and the number of set bits before it is its slot (stored beside each word of bits). A slot stores a 32-bit fingerprint of the
key and the key's row, rows store where their ids end. So a lookup is a few bit probes, one fingerprint check and one read of the span of ids. Files are
mapped where they are local and read in single places elsewhere: to open a shard reads its head alone, whatever its size.

Documents are dealt to shards by ranges of the key (of the text's beginning and of the input partition among equal keys), so shards in turn are in ascending key
order, no key is too frequent for one, and a document's global start is its shard's start (a sum over shard totals) plus its place in the shard. The number of
shards follows from the bytes of all texts and the number of rows, up to MOST_SHARDS; beyond that shards grow, so the manifest's size is bounded.

Free style (Arrow maps): building the hash and writing raw bytes need per-partition code. Each attempt of a task writes
files of its own names; the manifest names those of the attempts that succeeded, so nothing is ever moved or overwritten, and files of lost attempts are never read.
What comes to the driver is one row a shard.

Defined results: a null text is empty; a null key sorts first, is stored and scanned but never looked up; rows
that repeat a key are stored one after the other, ordered by the text's first TIE_LENGTH characters and then by a hash of the whole text, so equal rows alone have no order, and a lookup gives the first; a text of any length is one document (its ids are held at
once); an empty table gives no shard and no rows. Columns other than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import new_path, runs, ship
from .wordbpe import word_ids

MAGIC = b"QIDX0002"
HEAD = "<8sIIQQQQ"  # magic, width, levels, docs, null keys, distinct keys, ids
GAMMA = 2.0
MOST_LEVELS = 64
ROWS_AT_ONCE = 50_000
#: Bytes of text that a shard holds about, what a row counts besides its text, and the most shards.
SHARD_BYTES = 16 << 20
ROW_BYTES = 64
MOST_SHARDS = 1 << 16
#: Characters of a text that order rows of one key.
TIE_LENGTH = 64
#: Open shards kept a worker.
OPEN_SHARDS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over ``keys``, different for each ``seed``."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: bits a level, and all levels' words of bits with the set bits before each."""

    def __init__(self, sizes: list[int], words, ranks):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.first = np.cumsum([0, *(s >> 6 for s in sizes)]).tolist()

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [np.empty(0, "<u8")], keys
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~bits[at]]
        all_ = np.concatenate(words)
        set_ = np.bitwise_count(all_).astype(np.uint32)
        return cls(sizes, all_, (np.cumsum(set_, dtype=np.uint64) - set_).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that hit no bit (others that weren't built in get any slot)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mix(keys[left], k) % np.uint64(size)).astype(np.int64)
            place, bit = self.first[k] + (at >> 6), (at & 63).astype(np.uint64)
            word = self.words[place]
            hit = (word >> bit & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[place[hit]].astype(np.int64) + before
            left = left[~hit]
        return out


def index_bytes(keys: np.ndarray, nulls: int, ends: np.ndarray, width: int) -> bytes:
    """The index file of documents, ``nulls`` without a key and then those with ``keys`` in ascending order, that end at ``ends``."""
    distinct, first = np.unique(keys, return_index=True)
    mph = PerfectHash.build(distinct)
    slots = mph.slots(distinct)
    prints, rows = np.empty(len(distinct), "<u4"), np.empty(len(distinct), "<u8")
    prints[slots], rows[slots] = fingerprints(distinct), first + nulls
    parts = [struct.pack(HEAD, MAGIC, width, len(mph.sizes), len(ends), nulls, len(distinct), int(ends[-1]) if len(ends) else 0)]
    parts += [np.asarray(mph.sizes, "<u8").tobytes(), mph.words.tobytes(), mph.ranks.tobytes(), prints.tobytes(), rows.tobytes(), keys.astype("<i8").tobytes(), ends.astype("<u8").tobytes()]
    return b"".join(parts)


class _Section:
    """An array in a file, of which only the places asked for are read."""

    def __init__(self, file, mapped: memoryview | None, at: int, kind: str, n: int):
        self.file, self.at, self.kind, self.n = file, at, np.dtype(kind), n
        self.all = np.frombuffer(mapped, self.kind, n, at) if mapped is not None else None
        self.end = at + n * self.kind.itemsize

    def span(self, lo: int, hi: int) -> np.ndarray:
        if self.all is not None:
            return self.all[lo:hi]
        return np.frombuffer(self.file.read_at((hi - lo) * self.kind.itemsize, self.at + lo * self.kind.itemsize), self.kind)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if self.all is None and len(at) > 64:
            self.all = self.span(0, self.n)  # many places: one read
        if self.all is not None:
            return self.all[at]
        return np.concatenate([np.empty(0, self.kind), *(self.span(i, i + 1) for i in at.tolist())])


class Shard:
    """A shard that is open for reading; ``get`` is keyed access."""

    def __init__(self, ids: str, idx: str):
        file, mapped = self._open(idx)
        size = struct.calcsize(HEAD)
        magic, self.width, n_levels, self.n_docs, self.nulls, n_keys, self.n_ids = struct.unpack(HEAD, file.read_at(size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token index: {idx}")
        sizes = np.frombuffer(file.read_at(8 * n_levels, size), "<u8").astype(np.int64).tolist()
        words = sum(sizes) >> 6
        made, at = [], size + 8 * n_levels
        for kind, n in (("<u8", words), ("<u4", words), ("<u4", n_keys), ("<u8", n_keys), ("<i8", self.n_docs - self.nulls), ("<u8", self.n_docs)):
            made.append(_Section(file, mapped, at, kind, n))
            at = made[-1].end
        bits, ranks, self.prints, self.rows, self.keys, self.ends = made
        self.mph = PerfectHash(sizes, bits, ranks)
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.file, mapped = self._open(ids)
        if self.file.size() != self.n_ids * self.width:
            raise ValueError(f"{ids} has {self.file.size()} bytes; its index tells {self.n_ids * self.width}")
        self.ids = _Section(self.file, mapped, 0, self.kind.str, self.n_ids)

    @staticmethod
    def _open(uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).size:
            file = pa.memory_map(path)
            return file, memoryview(file.read_buffer())
        return fs.open_input_file(path), None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the shard hasn't it: one slot each, then its fingerprint, then the key there."""
        slots = self.mph.slots(keys)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == fingerprints(keys[there])
        rows = np.full(len(keys), -1, np.int64)
        rows[there] = self.rows[slots[there]].astype(np.int64)
        there[there] = self.keys[rows[there] - self.nulls] == keys[there]
        rows[~there] = -1
        return rows

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of ``rows`` begin and end."""
        ends = self.ends[rows].astype(np.int64)
        starts = np.zeros(len(rows), np.int64)
        starts[rows > 0] = self.ends[rows[rows > 0] - 1].astype(np.int64)
        return starts, ends

    def get(self, key: int) -> np.ndarray | None:
        row = self.find(np.asarray([key], np.int64))
        if row[0] < 0:
            return None
        (a,), (b,) = self.places(row)
        return self.ids.span(int(a), int(b))


_open_shards: dict[str, Shard] = {}


def open_shard(ids: str, idx: str) -> Shard:
    """The worker's open shard of these files; of many, those opened first are closed. One whose file has another size by now is opened, and so checked, anew."""
    if idx in _open_shards:
        fs, path = pafs.FileSystem.from_uri(ids)
        if fs.get_file_info(path).size != _open_shards[idx].n_ids * _open_shards[idx].width:
            del _open_shards[idx]
    if idx not in _open_shards:
        while len(_open_shards) >= OPEN_SHARDS:
            del _open_shards[next(iter(_open_shards))]
        _open_shards[idx] = Shard(ids, idx)
    return _open_shards[idx]


SHARD = "shard int, ids string, idx string, n_docs long, n_ids long, first_key long, last_key long, crc32 long"


def shard_count(docs: DataFrame, text: str) -> int:
    """How many shards hold about SHARD_BYTES each; rows without text count too, as ranges of the key deal rows."""
    weight = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0)) + F.lit(ROW_BYTES)
    return min(MOST_SHARDS, max(1, -(-(docs.agg(F.sum(weight).alias("n")).first()["n"] or 0) // SHARD_BYTES)))


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shards: int | None = None, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Write ``docs`` as token-id shards under the folder ``path``; returns the manifest, a row a shard in key order.

    ``path`` is a URI of a file system that pyarrow opens on the executors. Without ``shards`` there are as many as ``shard_count`` tells.
    """
    ship(docs.sparkSession)
    names = [f.split()[0] for f in SHARD.split(", ")]
    if shards is None:
        shards = shard_count(docs, text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fs, stem, sink, name = word_ids(tokenizer), None, "", None, ""
        keys: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        nulls = total = crc = 0
        for batch in batches:
            for part in runs(batch, "text"):
                if sink is None:
                    fs, folder = pafs.FileSystem.from_uri(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    stem = f"{folder}/{name}"
                    sink = fs.open_output_stream(f"{stem}.ids")
                ids, places = coder.encode(part.column("text"))
                body = np.insert(ids, places[1:], end_id).tobytes()
                crc = zlib.crc32(body, crc)
                sink.write(body)
                ends.append(total + places[1:] + np.arange(1, len(places)))
                total = int(ends[-1][-1])
                own = part.column("key")
                nulls += own.null_count
                keys.append(own.drop_null().to_numpy())
        if sink is None:
            return
        sink.close()
        known = np.concatenate(keys)
        with fs.open_output_stream(f"{stem}.idx") as f:
            f.write(index_bytes(known, nulls, np.concatenate(ends), coder.width))
        base = f"{path.rstrip('/')}/{name}"
        row = (TaskContext.get().partitionId(), f"{base}.ids", f"{base}.idx", nulls + len(known), total, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, crc)
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SHARD))
    order = ("key", "head", "hash", "part")
    src = docs.select(F.col(key).cast("long").alias("key"), F.substring(F.col(text), 1, TIE_LENGTH).alias("head"), F.xxhash64(F.col(text)).alias("hash"), F.spark_partition_id().alias("part"), F.col(text).alias("text"))
    made = src.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text").mapInArrow(write, SHARD).collect()
    return [r.asDict() for r in sorted(made, key=lambda r: r.shard)]


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Every document of the shards, read back from the files: each key's row is the one that its hash slot tells.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit).
    """
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in batch.to_pylist():
                shard, seen = open_shard(told["ids"], told["idx"]), 0
                keys = shard.keys.span(0, shard.n_docs - shard.nulls)
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
                for lo in range(0, shard.n_docs, ROWS_AT_ONCE):
                    hi = min(lo + ROWS_AT_ONCE, shard.n_docs)
                    a, b = max(0, lo - shard.nulls), max(0, hi - shard.nulls)
                    found = shard.find(keys[a:b])
                    if len(found) and found.min() < shard.nulls:
                        raise ValueError(f"the index {told['idx']} doesn't lead to all of its keys")
                    # Rows without a key are in turn; a key's later rows follow its first.
                    rows = np.concatenate((np.arange(lo, max(lo, min(hi, shard.nulls))), found + np.arange(a, b) - first[a:b]))
                    starts, ends = shard.places(rows)
                    crcs = []
                    for x, y in _spans(starts, ends):
                        raw = shard.ids.span(int(starts[x]), int(ends[y - 1]))
                        seen = zlib.crc32(raw.tobytes(), seen)
                        wide, base = memoryview(raw.astype("<u4").tobytes()), starts[x]
                        crcs += [zlib.crc32(wide[p:q]) for p, q in zip(((starts[x:y] - base) * 4).tolist(), ((ends[x:y] - base) * 4).tolist(), strict=True)]
                    out = [pa.concat_arrays([pa.nulls(hi - lo - (b - a), pa.int64()), pa.array(keys[a:b], pa.int64())]), told["base"] + starts, ends - starts, crcs]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                if seen != told["crc32"]:
                    raise ValueError(f"{told['ids']} was changed after it was written")

    base, rows = 0, []
    for m in manifest:
        rows.append((*(m[f.split()[0]] for f in SHARD.split(", ")), base))
        base += m["n_ids"]
    src = spark.createDataFrame(rows, f"{SHARD}, base long").repartition(max(1, len(rows)))
    return src.mapInArrow(read, schema)


def _spans(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows that lie one after the other, of at most ``most`` ids, or one row."""
    lo = 0
    breaks = [*(np.flatnonzero(starts[1:] != ends[:-1]) + 1).tolist(), len(starts)]
    for stop in breaks:
        while lo < stop:
            up = min(stop, max(lo + 1, int(np.searchsorted(ends[:stop], starts[lo] + most, "right"))))
            yield lo, up
            lo = up


def lookup(keys: DataFrame, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """``key`` and its ``ids`` (null where no shard has it): keyed access from the executors, without a shuffle."""
    ship(keys.sparkSession)
    known = [m for m in manifest if m["first_key"] is not None]
    firsts, paths, lasts = [m["first_key"] for m in known], [(m["ids"], m["idx"]) for m in known], [m["last_key"] for m in known]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_pylist()
            out: list = [None] * len(asked)
            by: dict[int, list[int]] = {}
            for i, k in enumerate(asked):
                s = bisect_right(firsts, k) - 1 if k is not None else -1
                while s > 0 and lasts[s - 1] == k:
                    s -= 1
                if s >= 0:
                    by.setdefault(s, []).append(i)
            for s, at in by.items():
                shard = open_shard(*paths[s])
                for i in at:
                    got = shard.get(asked[i])
                    out[i] = None if got is None else got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=[key, "ids"])

    return keys.select(F.col(key).cast("long").alias(key)).mapInArrow(find, f"{key} long, ids array<int>")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to fresh shards in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer, new_path(spark, "ids"), end_id))
