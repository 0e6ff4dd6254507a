"""The entry index: archives' directories as a table, and range reads of the entries that a query names.

An archive ends with a directory of its entries. ``entry_index`` reads that alone, by seeking, so a book costs some KB whatever its size; ``read_entries`` reads the bytes of single entries, by their offsets, and
checks them. So images of a library are found, filtered and fetched without reading the rest of any container. Files are opened through pyarrow's file systems on the executors.
"""

from __future__ import annotations

import os
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normpath
from .container import Archive, failed

#: n counts entries in the order of the directory; a book whose directory can't be read has one row, without a name.
ENTRIES = "book string, n int, name string, method int, encrypted boolean, offset long, packed long, size long, crc32 long, error_code int, error string"
#: Bytes of contents in an Arrow batch; a larger entry is one of its own.
BATCH_BYTES = 4 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, its path there, and what goes before such paths to name them."""
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path), ""
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner, "" if isinstance(fs, pafs.LocalFileSystem) else path[: path.index("://") + 3] + (path.split("/")[2] if path.startswith("hdfs://") else "")


def open_file(path: str) -> IO[bytes]:
    fs, inner, _ = file_system(path)
    return fs.open_input_file(inner)


def entries_of(book: str, opened: Callable[[], IO[bytes]], mode: str = "PERMISSIVE") -> list[tuple]:
    """The directory of one archive."""
    try:
        with opened() as f:
            return [(book, n, i.filename, i.compress_type, bool(i.flag_bits & 1), i.header_offset, i.compress_size, i.file_size, i.CRC, None, None) for n, i in enumerate(Archive(f).zip.infolist())]
    except Exception as e:
        if mode.upper() == "FAILFAST":
            raise
        code, said = failed(book, e)["books"][0][-2:]
        return [] if mode.upper() == "DROPMALFORMED" else [(book, *[None] * 8, code, said)]


def book_files(spark: SparkSession, path: str | list[str], pattern: str = "*.epub") -> DataFrame:
    """book, length of the containers below ``path``, listed by Spark without opening any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("book"), "length")


def entry_index(books: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """The directories of ``books`` (column ``book``: a path or URI)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ENTRIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0).to_pylist():
                rows = entries_of(book, lambda book=book: open_file(book), mode)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return books.select("book").mapInArrow(run, ENTRIES)


def _inflated(f: IO[bytes], e: dict) -> bytes:
    """The bytes of one entry: those from its header on, checked against the directory."""
    if e["encrypted"]:
        raise ValueError("is encrypted")
    f.seek(e["offset"])
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("is damaged")
    f.seek(e["offset"] + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = f.read(e["packed"])
    try:
        data = raw if e["method"] == zipfile.ZIP_STORED else zipfile._get_decompressor(e["method"]).decompress(raw)
    except NotImplementedError:
        raise ValueError("is compressed in an unknown way") from None
    except Exception:
        raise ValueError("is damaged") from None
    if len(data) != e["size"] or zlib.crc32(data) != e["crc32"]:
        raise ValueError("is damaged")
    return data


def read_entries(wanted: DataFrame) -> DataFrame:
    """``wanted`` (rows of the index, with other columns as they are) with ``content``; for an entry that can't be read that is null, and ``error_code`` and ``error`` say why.

    A file stays open for rows of one book that follow each other, as they do in the index.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    kind = StructType([StructField(f.name, f.dataType) for f in wanted.schema if f.name != "content"] + [StructField("content", BinaryType())])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
        for batch in batches:
            held, out = 0, []
            for row in batch.to_pylist():
                data, code, said = None, row["error_code"], row["error"]
                if row["name"] is not None and not row["name"].endswith("/"):
                    try:
                        if name != row["book"]:
                            if file:
                                file.close()
                            name, file = None, None
                            name, file = row["book"], open_file(row["book"])
                        data = _inflated(file, row)
                    except ValueError as e:
                        code, said = -1, f"{row['name']} {e}"
                    except OSError as e:
                        code, said = -1, str(e)
                out.append(row | {"content": data, "error_code": code, "error": said})
                held += len(data or b"")
                if held > BATCH_BYTES:
                    yield made(out)
                    held, out = 0, []
            if out:
                yield made(out)
        if file:
            file.close()

    return wanted.drop("content").mapInArrow(run, kind)


def with_content(items: DataFrame, books: DataFrame, index: DataFrame) -> DataFrame:
    """``items`` (read without contents, and filtered as a query needs) with the bytes of their entries, and ``error``; no other entry is read. An item without an entry keeps null, as ``Can not find`` says."""
    folder = books.where("error_code IS NULL").select("book", "folder")
    at = F.when(F.coalesce("folder", F.lit("")) == "", F.col("file_name")).otherwise(F.concat_ws("/", "folder", "file_name"))
    asked = items.drop("content").join(folder, "book").withColumn("name_", normpath(at)).drop("folder")
    rest = [c for c in asked.columns if c not in ("book", "name_")]
    asked = asked.select("book", F.col("name_").alias("name"), F.struct(*rest).alias("item_"))
    own = asked.join(index.drop("n").where("name IS NOT NULL"), ["book", "name"], "left")
    own = own.withColumns({"error_code": F.when(F.col("offset").isNull(), -1), "error": F.when(F.col("offset").isNull(), F.concat(F.lit("Can not find "), F.col("item_.file_name")))})
    looked = own.withColumn("entry_", F.col("name")).withColumn("name", F.when(F.col("offset").isNotNull(), F.col("name")))
    done = read_entries(looked.sortWithinPartitions("book", "offset"))
    return done.select("book", *[F.col(f"item_.{c}").alias(c) for c in rest], "content", "error")
