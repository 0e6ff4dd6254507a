"""Books as DataFrames.

``read_corpus`` scans containers through Spark's binary files, on any file system that Spark reads; ``format("epub")``
(after ``register``) is the same as a data source, for single tables, folders of unpacked books and writing; it lists and reads any file system that pyarrow opens.
A container isn't splittable: one is read by one task.

Containers are opened once for all tables where tables are kept: ``Corpus.save``, ``Corpus.staged`` and the incremental ingest parse each file once, into
rows tagged with their table, which are then split. A table that is read on its own parses for itself, but by the same ``Reading``, so a book that can't be read is told by every table, every way of reading and
``quarantine`` alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

from ..constants import CONTAINER_PATH
from ..schemas import QUARANTINE, TABLES
from ..workdir import new_path, written
from .container import Archive, failed, folder_reader, read_tables
from .entries import ENTRIES, entries_of
from .entries import file_system as _file_system


def _arrow(schema: str | StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cell = lambda v, t: list(v.items()) if isinstance(v, dict) else [dict(zip(("k", "v"), x, strict=True)) for x in v] if pa.types.is_list(t) and pa.types.is_struct(t.value_type) and v else v
    return pa.RecordBatch.from_arrays([pa.array([cell(r[k], f.type) for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


@dataclass(frozen=True)
class Reading:
    """How books are read: every table of a book is told from the same reading, so a book that can't be read is one in all of them.

    ``mode``: PERMISSIVE (a row of ``books`` and of ``quarantine`` says why), DROPMALFORMED (no rows, but in ``quarantine``) or FAILFAST (the query ends). ``corrupt`` names a column that every table then
    has at its end: null, but for a book that can't be read, which has a row in each with its name and what is wrong.
    """

    ignore_ncx: bool = True
    content: bool = True
    mode: str = "PERMISSIVE"
    corrupt: str | None = None

    def schema(self, table: str) -> str:
        return QUARANTINE if table == "quarantine" else TABLES[table] + (f", {self.corrupt} string" if self.corrupt else "")

    def tables(self, book: str, opened: Callable[[], Callable[[str], bytes]], only: str | None = None) -> dict[str, list[tuple]]:
        """Rows of the tables of one book (but ``only`` one is used: contents are kept for items alone)."""
        try:
            out = read_tables(book, opened(), self.ignore_ncx, self.content, only in (None, "items"))
        except Exception as e:
            if self.mode.upper() == "FAILFAST":
                raise
            out = failed(book, e)
            told = out["books"][0]
            dropped = self.mode.upper() == "DROPMALFORMED"
            if self.corrupt and not dropped:
                out = {t: [(book, *[None] * (_width(t) - 1), told[-1])] for t in TABLES} | {"books": [(*told, told[-1])]}
            return ({} if dropped else out) | {"quarantine": [(book, told[-2], told[-1])]}
        return {t: [(*r, None) for r in rows] for t, rows in out.items()} if self.corrupt else out


@cache
def _width(table: str) -> int:
    return len(re.split(r", (?=\w+ \w)", TABLES[table]))


@dataclass
class Corpus:
    """The tables of many books; each attribute is a DataFrame."""

    books: DataFrame
    metadata: DataFrame
    items: DataFrame
    spine: DataFrame
    toc: DataFrame
    guide: DataFrame
    page_list: DataFrame
    bindings: DataFrame
    #: The containers that the tables were read from, how, and the tables as they were then: one that was changed since isn't read again.
    files: DataFrame | None = None
    options: Reading = Reading()
    read: tuple = ()
    #: book, error_code, error of the books that couldn't be read, whatever the mode.
    quarantine: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def staged(self) -> Corpus:
        """The same tables, each container opened once and all rows kept in the shared folder."""
        if self.files is None or any(a is not b for a, b in zip(self.read, self.tables().values(), strict=True)):
            return Corpus(**{t: written(df, t) for t, df in self.tables().items()}, quarantine=None if self.quarantine is None else written(self.quarantine, "quarantine"))
        return parse_once(self.files, self.options)

    def save(self, path: str) -> None:
        """Write all tables as Parquet, so that later queries prune columns and don't open containers again. Each container is opened once."""
        own = self.staged() if self.files is not None else self
        for name, df in (own.tables() | ({} if own.quarantine is None else {"quarantine": own.quarantine})).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


    def save_tables(self, path: str, prefix: str = "", buckets: int = 64) -> None:
        """Write all tables below ``path`` as tables of the catalogue, named with ``prefix``, in buckets by book and sorted by book and id: lookups of ids in a book's items, and what groups by book, then find rows of one
        book together, and the items aren't dealt anew. (Spark takes part of a join's keys for that only with ``spark.sql.requireAllClusterKeysForCoPartition`` off.)"""
        own = self.staged() if self.files is not None else self
        for name, df in own.tables().items():
            order = ["book", *[c for c in ("id", "seq", "path", "pos") if c in df.columns][:1]]
            df.write.mode("overwrite").option("path", f"{path}/{name}").bucketBy(buckets, "book").sortBy(*order).saveAsTable(prefix + name)


def corpus_of_tables(spark: SparkSession, prefix: str = "") -> Corpus:
    """A corpus that ``save_tables`` wrote."""
    return Corpus(**{t: spark.table(prefix + t) for t in TABLES})


def load_corpus(spark: SparkSession, path: str) -> Corpus:
    """A corpus that ``save`` wrote."""
    return Corpus(**{t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()})


def parse_containers(files: DataFrame, table: str, reading: Reading = Reading()) -> DataFrame:
    """One table of the containers in ``files`` (book, content), a batch or streaming DataFrame."""
    said = reading.schema(table)
    schema = _arrow(said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, raw in zip(batch.column(0), batch.column(1), strict=True):  # a book at a time bounds memory
                rows = reading.tables(book.as_py(), lambda raw=raw: Archive(raw.as_py()), table).get(table, [])
                if rows:
                    yield _batch(schema, rows)

    return files.select("book", "content").mapInArrow(run, said)


def parse_once(files: DataFrame, reading: Reading = Reading()) -> Corpus:
    """All tables of the containers in ``files`` by one pass over them: rows tagged with their table are written to the shared folder, and each table reads its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {t: _parse_datatype_string(reading.schema(t)) for t in (*TABLES, "quarantine")}
    tagged = StructType().add("table", "string")
    for t, kind in kinds.items():
        tagged = tagged.add(t, kind)
    arrow, each = to_arrow_schema(tagged), {t: _arrow(kind) for t, kind in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, raw in zip(batch.column(0), batch.column(1), strict=True):
                for t, rows in reading.tables(book.as_py(), lambda raw=raw: Archive(raw.as_py())).items():
                    if rows:
                        own = _batch(each[t], rows)
                        made = pa.StructArray.from_arrays(own.columns, fields=list(own.schema))
                        cells = [pa.array([t] * len(rows)) if f.name == "table" else made.cast(f.type) if f.name == t else pa.nulls(len(rows), f.type) for f in arrow]
                        yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    spark = files.sparkSession
    path = new_path(spark, "parsed")
    files.select("book", "content").mapInArrow(run, tagged).write.partitionBy("table").parquet(path)
    read = lambda t: spark.read.schema(StructType([tagged[t], tagged["table"]])).parquet(path).where(F.col("table") == t).select(f"{t}.*")
    return Corpus(**{t: read(t) for t in kinds})


def containers(spark: SparkSession, path: str | list[str], pattern: str = "*.epub", where: str | None = None) -> DataFrame:
    """book, content of the containers below ``path``; ``where`` is SQL over path, length and modificationTime, of which Spark's scan takes what it can (length and time) before files are opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.where(where) if where else files
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("book"), "content")


def read_corpus(spark: SparkSession, path: str | list[str], ignore_ncx: bool = True, mode: str = "PERMISSIVE", pattern: str = "*.epub", content: bool = True, where: str | None = None, corrupt: str | None = None) -> Corpus:
    """All tables of the containers below ``path``, by ``containers``, and ``quarantine``; ``mode`` and ``corrupt`` are those of ``Reading``.

    Without ``content`` the items' bytes are null and no document is inflated but those that tables are read from; entries that are missing, encrypted or compressed in an unknown way are told all the
    same, damaged ones that aren't read are not.
    """
    files, reading = containers(spark, path, pattern, where), Reading(ignore_ncx, content, mode, corrupt)
    tables = {t: parse_containers(files, t, reading) for t in TABLES}
    return Corpus(**tables, files=files, options=reading, read=tuple(tables.values()), quarantine=parse_containers(files, "quarantine", reading))


class EpubDataSource(DataSource):
    """``spark.read.format("epub")``, ``readStream`` and ``writeStream`` (``quire.sources.stream``); options: path, table (items; quarantine and entries too), ignore_ncx (true), content (true), mode (PERMISSIVE), corrupt (a column's name), and pushdown (false;
    books asked for by name alone are opened, where spark.sql.python.filterPushdown.enabled is set).

    Containers are opened by seeking: with content false a table reads a book's directory and the few entries that it is told by, not the container.
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        table = self.options.get("table", "items")
        return ENTRIES if table == "entries" else _reading(self.options).schema(table)

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if str(options.get("pushdown", "")).lower() == "true" else _Reader)(options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)

    def streamReader(self, schema: StructType):
        from .stream import EpubStreamReader

        return EpubStreamReader(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool):
        from .stream import EpubStreamWriter

        return EpubStreamWriter(dict(self.options), schema)


@dataclass
class _Books(InputPartition):
    paths: list


#: Bytes of containers that a partition of the data source reads, and what a file counts beside its bytes.
PARTITION_BYTES = 64 << 20
FILE_BYTES = 1 << 20


def _reading(options: dict) -> Reading:
    """The reading that a data source's options ask for."""
    flag = lambda k: str(options.get(k, True)).lower() == "true"
    return Reading(flag("ignore_ncx"), flag("content"), str(options.get("mode", "PERMISSIVE")), options.get("corrupt"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = {k.lower(): v for k, v in options.items()}, _arrow(schema)
        self.only: set | None = None

    def partitions(self) -> list[InputPartition]:
        fs, path, front = _file_system(self.options["path"])
        top = fs.get_file_info(path)
        if top.type == pafs.FileType.File:
            sizes = {path: top.size}
        else:
            found = [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if not re.search("/[_.]", i.path[len(path) :])]
            marks = f"/{CONTAINER_PATH}"
            folders = {i.path.removesuffix(marks): 0 for i in found if i.type == pafs.FileType.File and f"/{i.path}".endswith(marks)}
            sizes = {i.path: i.size or 0 for i in found if i.type == pafs.FileType.File and i.path.endswith(".epub")}
            for i in found:
                parts = i.path.split("/")
                for n in range(1, len(parts)):
                    if (above := "/".join(parts[:n])) in folders:
                        folders[above] += i.size or 0
            sizes = {p: n for p, n in sizes.items() if not any(p.startswith(f"{f}/") for f in folders)} | folders if folders else sizes
        out: list[_Books] = []
        held = 0
        for p in sorted(sizes):
            if self.only is not None and front + p not in self.only:
                continue
            if not out or held + sizes[p] + FILE_BYTES > PARTITION_BYTES:
                out.append(_Books([]))
                held = 0
            out[-1].paths.append(p)
            held += sizes[p] + FILE_BYTES
        return out or [_Books([])]

    def read(self, partition: _Books) -> Iterator[pa.RecordBatch]:
        table, reading = self.options.get("table", "items"), _reading(self.options)
        fs, _, front = _file_system(self.options["path"])
        for path in partition.paths:
            if table == "entries":
                yield _batch(self.schema, entries_of(front + path, lambda p=path: fs.open_input_file(p), reading.mode))
                continue
            with ExitStack() as stack:

                def opened(path: str = path) -> Callable[[str], bytes]:
                    if fs.get_file_info(path).type == pafs.FileType.Directory:
                        return folder_reader(path, None if isinstance(fs, pafs.LocalFileSystem) else fs)
                    return Archive(stack.enter_context(fs.open_input_file(path)))

                rows = reading.tables(front + path, opened, table).get(table)
            if rows:
                yield _batch(self.schema, rows)


class _PushingReader(_Reader):
    """Spark refuses a reader that has this method unless the session enables it, so it is asked for by an option."""

    def pushFilters(self, filters: list) -> Iterator:
        """Books asked for by name: others aren't opened. Spark applies the filter again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("book",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("book",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            yield f


@dataclass
class _Written(WriterCommitMessage):
    """What a task tells the driver: the folder that it wrote into, and how many books."""

    folder: str | None
    books: int


class _Writer(DataSourceWriter):
    """Writes rows (book, data), a container each, on any file system that pyarrow opens. A task writes into a folder of its attempt; at the commit each such folder becomes a part of the output by one
    move, so the driver handles a name a task, not one a book. Overwriting drops the parts and containers that lay right in the folder before."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        import uuid

        self.path, self.columns, self.overwrite, self.job = options["path"], schema.names, overwrite, uuid.uuid4().hex
        if not {"book", "data"} <= set(self.columns):
            raise ValueError("the epub sink takes columns book and data, as quire.sources.writer.pack makes them")

    def _attempts(self, folder: str) -> str:
        return f"{folder}/_attempts-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        fs, folder, _ = _file_system(self.path)
        own, seen = f"{self._attempts(folder)}/{uuid.uuid4().hex}", set()
        for r in rows:
            name = file_name(r["book"])
            if name in seen:
                raise ValueError(f"books can't be written under one name: {name}")
            seen.add(name)
            fs.create_dir(os.path.dirname(f"{own}/{name}"), recursive=True)
            with fs.open_output_stream(f"{own}/{name}") as f:
                f.write(r["data"])
        return _Written(own if seen else None, len(seen))

    def commit(self, messages: list) -> None:
        fs, folder, _ = _file_system(self.path)
        before = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if self.overwrite else []
        for k, m in enumerate(messages):
            if m and m.folder:
                fs.move(m.folder, f"{folder}/part-{k:05d}-{self.job}")
        for i in before:
            if i.type == pafs.FileType.Directory and re.fullmatch(r"part-\d{5}-[0-9a-f]{32}", i.base_name):
                fs.delete_dir(i.path)
            elif i.is_file and i.base_name.endswith(".epub"):
                fs.delete_file(i.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder, _ = _file_system(self.path)
        if fs.get_file_info(self._attempts(folder)).type == pafs.FileType.Directory:
            fs.delete_dir(self._attempts(folder))


def file_name(book: str) -> str:
    """A book's file below a folder: its name with its folders, without scheme, and with the ending once."""
    parts = [p for p in book.partition("://")[2 if "://" in book else 0].split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{book!r} leads out of the folder")
    return "/".join(parts).removesuffix(".epub") + ".epub"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubDataSource)
