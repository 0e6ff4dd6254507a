"""Shards along a Hilbert curve over metadata.

Each metadata dimension is quantised to ``2**bits`` buckets at quantiles of the whole table, the buckets are the
coordinates of a cell, and rows are ordered by the place of their cell on the Hilbert curve. Runs cut from that order
keep each dimension narrow at once, so a reader prunes whole shards by the minimum and maximum of any of them.

DataFrame expressions only. The curve is a table of ``2**(bits * dimensions)`` cells (32,768 at 5 bits and three
dimensions), built from Skilling's rule, and broadcast under that bound. A cell can hold any share of the rows, so ranks
are not given by one global or per-cell sort: a cell is split by a hash of the row and of its input partition into SALTS parts, rows are
numbered within the part, and each part is offset by the counts before it. Per-cell totals, at most one row a cell, are the only
thing that a single task orders.

Cut points of numbers are approximate quantiles; those of strings are exact quantiles of whole values, however long a beginning they
share (and every value, where there are fewer values than buckets): values are counted, the counts dealt by range and summed in each range.

Defined results: a null coordinate is in a bucket of its own before all others; strings are compared by code point, whole, of any length; a null text
counts 0 bytes and has the checksum of an empty one, a very long one counts as many as it has; ties on the curve are in the order of the parts, then of
key, size and checksum; rows with a null key and repeated rows take a slot each; an empty table gives no rows. Columns other than key, text and the
dimensions are ignored by ``assign``; ``write_shards`` keeps them all, and names its own column ``shard_`` where ``shard`` is taken (with as many underscores as it needs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, free_name

SALTS = 256
BITS = 5
DIMENSIONS = ("source", "lang", "n_chars")


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve (Skilling 2004)."""
    x, n = list(point), len(point)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


#: Bits of a cell at most.
CURVE_BITS = 16


def curve(bits: int, dimensions: int) -> list[tuple[int, int]]:
    """(cell, place) of all cells; a cell is its coordinates' bits one after the other. There may be 2 ** CURVE_BITS of them at most, as they are made on the driver and broadcast."""
    if bits * dimensions > CURVE_BITS:
        raise ValueError(f"{dimensions} dimensions of {bits} bits have more than 2 ** {CURVE_BITS} cells")
    mask = (1 << bits) - 1
    return [(c, curve_index(tuple(c >> bits * (dimensions - 1 - d) & mask for d in range(dimensions)), bits)) for c in range(1 << bits * dimensions)]


def code(df: DataFrame, name: str) -> Column:
    """The column's value as cut points compare it: a string as it is, anything else as a number."""
    return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("double")


def string_cuts(df: DataFrame, name: str, n: int) -> list[str]:
    """At most ``n - 1`` ascending cut points of a string column, at the exact n-quantiles of its values over all rows.

    A value is one row of the counts, whatever its share of ``df``; those are dealt by range, so no task sees all values.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = {r["part"]: (r["n"], r["values"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("values")).collect()}
    if sum(v for _, v in sums.values()) < n:
        return sorted((r["v"] for r in dealt.select("v").collect()), key=str.encode)[:-1]  # each value has a bucket
    before, whole = {}, 0
    for part in sorted(sums):
        before[part] = whole
        whole += sums[part][0]
    # A row a range, so that it can be broadcast.
    ranges = df.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    # A value is a cut point if it reaches a multiple of whole / n that those before it don't.
    step = lambda c: F.floor(c * F.lit(n) / F.lit(whole))
    found = dealt.join(F.broadcast(ranges), "part").withColumn("upto", upto).where((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < whole))
    return sorted((r["v"] for r in found.select("v").collect()), key=str.encode)


def quantiles(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> list[list[float] | list[str]]:
    """Ascending cut points of each dimension over all rows: at most ``2**bits - 2`` values each."""
    n = (1 << bits) - 1
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    text = {d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)}
    numbers = [d for d in dimensions if d not in text]
    row = df.agg(F.count("*"), *[F.array_sort(F.array_distinct(F.percentile_approx(code(df, d), shares, 10_000))).alias(f"d{i}") for i, d in enumerate(numbers)]).first() if numbers else None
    told = {d: list(row[f"d{i}"] or []) for i, d in enumerate(numbers)}
    return [string_cuts(df, d, n) if d in text else told[d] for d in dimensions]


def bucket(value: Column, cuts: list) -> Column:
    """0 for null, else 1 and the number of cut points below the value."""
    over = F.lit(1)
    for c in cuts:
        over = over + (value > F.lit(c)).cast("int")
    return F.when(value.isNull(), 0).otherwise(over)


def _placed(docs: DataFrame, shards: int, law: str, dimensions: tuple[str, ...], bits: int, key: str, text: str, extra: int, *kept: Column) -> DataFrame:
    """Every row's doc_id, size, text_crc32, place on the curve, shard and slot, and the columns ``kept``."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark = docs.sparkSession
    cuts = quantiles(docs, dimensions, bits)
    cell = F.lit(0)
    for d, points in zip(dimensions, cuts, strict=True):
        cell = cell * F.lit(1 << bits) + bucket(code(docs, d), points)
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    own = docs.select(F.col(key).alias("doc_id"), (F.length(raw) + F.lit(extra)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), cell.cast("int").alias("cell"), *kept)
    places = spark.createDataFrame(curve(bits, len(dimensions)), "cell int, place int")
    own = own.join(F.broadcast(places), "cell").drop("cell")
    # The input partition splits rows that are equal in all; the written table holds on to it.
    own = cut(own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.spark_partition_id()), F.lit(SALTS)).cast("int")), "hilbert")

    parts = own.groupBy("place", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    cells = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    line, whole = Window.orderBy("place"), Window.partitionBy()
    cells = cells.select(
        "place",
        (F.sum("n").over(line) - F.col("n")).alias("n_before"), (F.sum("bytes").over(line) - F.col("bytes")).alias("bytes_before"),
        F.sum("n").over(whole).alias("n_all"), F.sum("bytes").over(whole).alias("bytes_all"),
    )
    inner = Window.partitionBy("place").orderBy("salt")
    parts = parts.select("place", "salt", (F.sum("n").over(inner) - F.col("n")).alias("n_in"), (F.sum("bytes").over(inner) - F.col("bytes")).alias("bytes_in")).join(cells, "place")
    parts = parts.select("place", "salt", (F.col("n_in") + F.col("n_before")).alias("n_before"), (F.col("bytes_in") + F.col("bytes_before")).alias("bytes_before"), "n_all", "bytes_all")
    within = Window.partitionBy("place", "salt").orderBy("doc_id", "size", "text_crc32")
    rows = own.withColumns({"i": F.row_number().over(within), "b": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.join(parts, ["place", "salt"]).withColumn("rank", F.col("n_before") + F.col("i") - 1)
    if law == "rows":
        rows = rows.withColumn("shard", F.expr(f"rank * {shards} div n_all"))
        # The first rank of shard s is the ceiling of s * n / shards.
        slot = F.col("rank") - F.expr(f"(shard * n_all + {shards - 1}) div {shards}")
    else:
        middle = F.expr("bytes_before + b - size div 2 - 1")
        rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.greatest(middle, F.lit(0)) * shards / F.col("bytes_all"))).cast("long"))
        firsts = rows.groupBy("shard").agg(F.min("rank").alias("first_rank"))
        rows = rows.join(F.broadcast(firsts), "shard")  # a row a shard
        slot = F.col("rank") - F.col("first_rank")
    return rows.withColumns({"shard": F.col("shard").cast("int"), "slot": slot.cast("long")})


def assign(docs: DataFrame, shards: int = 40, law: str = "rows", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, key: str = "doc_id", text: str = "text", extra: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the curve place of every row.

    ``law`` is ``rows`` (shard counts differ by one at most) or ``bytes`` (runs of near-equal bytes).
    """
    rows = _placed(docs, shards, law, dimensions, bits, key, text, extra)
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("place").alias("curve_place"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, law: str = "rows", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, key: str = "doc_id", text: str = "text") -> str:
    """Write ``docs`` as Parquet, one folder a shard, each in slot order; returns the name of the folders' column.

    Each row travels with its place, so exactly the rows of ``docs`` are written, whatever their keys.
    """
    name = free_name("shard", docs.columns)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = _placed(docs, shards, law, dimensions, bits, key, text, 16, held).select(F.col("shard").alias("s_"), F.col("slot").alias("p_"), "row")
    dealt = placed.repartitionByRange("s_", "p_").sortWithinPartitions("s_", "p_")
    dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("s_").alias(name)).write.partitionBy(name).parquet(path)
    return name


def zone_map(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shard: str = "shard") -> DataFrame:
    """Each shard's rows, and minimum and maximum of each dimension."""
    ends = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("rows"), *ends)


def prune(zones: DataFrame, wanted: dict[str, tuple[object, object]]) -> DataFrame:
    """The shards that may hold rows whose every dimension lies in the wanted closed range."""
    keep = F.lit(True)
    for d, (lo, hi) in wanted.items():
        keep = keep & (F.col(f"max_{d}") >= F.lit(lo)) & (F.col(f"min_{d}") <= F.lit(hi))
    return zones.where(keep).select("shard")
