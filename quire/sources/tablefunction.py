"""A table function over containers, for SQL: ``SELECT * FROM read_books(TABLE(files), 'toc')``.

What it returns depends on the table that is asked for, so its columns are told when a query is analysed. Rows are read where they lie; nothing is dealt anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import QUARANTINE, TABLES
from .container import Archive
from .reader import Reading


def register_function(spark: SparkSession, name: str = "read_books", reading: Reading = Reading()) -> None:
    """Make the function callable from SQL: its arguments are a table with columns book and content (as ``containers`` and binary files with a name give them) and the name of the table to read."""
    kinds = {t: _parse_datatype_string(reading.schema(t)) for t in TABLES} | {"quarantine": _parse_datatype_string(QUARANTINE)}

    class ReadBooks:
        @staticmethod
        def analyze(files: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable or not {"book", "content"} <= set(files.dataType.names):
                raise ValueError(f"{name} reads a table with columns book and content")
            if not table.isConstantExpression or table.value not in kinds:
                raise ValueError(f"{name} reads one of {', '.join(kinds)}")
            return AnalyzeResult(schema=kinds[table.value])

        def eval(self, row: Row, table: str) -> Iterator[tuple]:
            yield from _cells(reading.tables(row["book"], lambda: Archive(bytes(row["content"])), table).get(table, []), kinds[table])

    spark.udtf.register(name, udtf(ReadBooks))


def _cells(rows: list[tuple], kind) -> Iterator[tuple]:
    """Rows with pairs as structs, and maps as they are."""
    from pyspark.sql.types import ArrayType, StructType

    pairs = [isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType) for f in kind]
    for r in rows:
        yield tuple([tuple(x) for x in v] if p and v is not None else v for p, v in zip(pairs, r, strict=True))
