"""Mixing sources to target weights, by blocks.

A source's documents, in a fixed pseudorandom order, are one stream of words, packed into blocks of a fixed length (its last
block holds what is left). The mix is a row of slots in output shards, each for one block. How many slots of a shard go to which
source is drawn: a multinomial draw given each source's total, as independent draws would miss the targets by their own
noise (the draw for a shard follows a binary tree from all slots down to the shard, each split from a seed of its own; any task can draw any
shard alone, and the law is the same at every size). A source's k-th slot takes the block that a keyed permutation of its block
numbers maps k to, another permutation for each pass over the source. Slots and blocks meet in a join on (source, block). A source's last
slot leaves off the words of its block by which it would go beyond the target, so targets are met to the word (rounded down).

What the driver holds is a row a source; more than MOST_SOURCES are refused, as weights by source would then mean nothing.
Streams don't gather a source in one task: it is split by a hash into SALTS parts, words are summed within the part, and each
part is offset by the sums before it. Rows that repeat a document are counted before that, and take their places in turn afterwards.

Free style: draws and permutations are an Arrow map, the rest DataFrame operations.

Defined results: a null text has no words; a null source is the last source; documents without words, empty ones too, are never taken;
a document longer than a block, of any length, lies in as many blocks as it needs, and parts of it may be taken alone; repeated
rows, and rows with a null key, are documents of their own; ties in the order don't exist, as documents that are equal in it are repeats; an empty table gives no
rows; other columns are ignored, whatever their names (``mixed_documents`` hands them on). Equal seeds give equal mixes, however the rows are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, cut, free_name, runs, ship

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 1024
MOST_SOURCES = 100_000
#: Copies of a row that one task numbers.
COPIES = 4096
#: Draws that are made one by one.
FEW_DRAWS = 8


def targets(sizes: dict, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """The target of each source: weights repeat over sources by code point (null last); targets stop at ``most`` times
    the source's size and the excess is shared again by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = dict.fromkeys(order, 0.0)
    open_, left = [s for s in order if sizes[s]], share * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return from ``good + bad`` are good, exactly by the hypergeometric law at any size.

    Each member gets a uniform mark, and those with the least ``n`` marks are drawn. Two binomial draws tell how many marks of
    either kind are below n / (good + bad); the few that these are too many or too few are drawn in the same way.
    """
    drawn, sign = 0, 1
    while n > FEW_DRAWS:
        if 2 * n > good + bad:  # those that stay are fewer
            drawn, sign, n = drawn + sign * good, -sign, good + bad - n
            continue
        p = n / (good + bad)
        low_good, low_bad = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        drawn += sign * low_good
        if low_good + low_bad <= n:
            good, bad, n = good - low_good, bad - low_bad, n - low_good - low_bad
        else:
            good, bad, n, sign = low_good, low_bad, low_good + low_bad - n, -sign
    for _ in range(n):
        hit = int(rng.integers(good + bad)) < good
        drawn, good, bad = drawn + sign * hit, good - hit, bad - (not hit)
    return drawn


def _split(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by source of ``n`` slots drawn from ``quotas``."""
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        out[i] = x = _draw(rng, q, rest, n) if n and q else 0
        n -= x
    return out


def shard_counts(quotas: np.ndarray, per_shard: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(each source's slots before ``shard``, its slots in it)."""
    total = int(quotas.sum())
    lo, hi, before = 0, -(-total // per_shard), np.zeros_like(quotas)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(quotas, (mid - lo) * per_shard, np.random.default_rng((seed, lo, hi)))
        if shard < mid:
            quotas, hi = left, mid
        else:
            before, quotas, lo = before + left, quotas - left, mid
    return before, quotas


def _network(n: int, key: int) -> tuple[int, np.ndarray]:
    """Bits of a half, and the rounds' keys, of the Feistel network over the next even power of two."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2), np.random.default_rng(key).integers(1, 1 << 63, 4, np.uint64)


def _round(half: int, right: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
        return (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - half)


def _walked(x: np.ndarray, n: int, step) -> np.ndarray:
    """``step`` again and again, until inside 0..n-1."""
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        out[todo] = got = step(out[todo])
        todo = todo[got >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``index``: a Feistel network, walked until inside."""
    half, keys = _network(n, key)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
        for k in keys:
            left, right = right, left ^ _round(half, right, k)
        return left << np.uint64(half) | right

    return _walked(index, n, step)


def place_of(value: np.ndarray, n: int, key: int) -> np.ndarray:
    """The index that ``permuted`` maps to ``value``."""
    half, keys = _network(n, key)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
        for k in keys[::-1]:
            left, right = right ^ _round(half, left, k), left
        return left << np.uint64(half) | right

    return _walked(value, n, step)


def pass_key(seed: int, source: int, turn: int) -> int:
    return seed * 1_000_003 + source * 31 + turn


def quota(size: int, words: int, block: int, seed: int, source: int) -> tuple[int, int]:
    """(slots of a source of ``size`` words, words that its last slot leaves off), so that its slots hold ``words`` words."""
    n = -(-size // block)
    if not n or not words:
        return 0, 0
    turns, rest = divmod(words, size)
    short = n * block - size  # of the last block
    if not rest:
        return turns * n, 0
    slots = -(-rest // block)
    if int(place_of(np.asarray([n - 1]), n, pass_key(seed, source, turns))[0]) < slots:  # the short block comes before
        slots = -(-(rest + short) // block)
        return turns * n + slots, slots * block - short - rest
    return turns * n + slots, slots * block - rest


def copies(df: DataFrame, n: str = "n", copy: str = "copy") -> DataFrame:
    """A row for each of the ``n`` copies that a row stands for, numbered from 0; many copies are numbered by many tasks."""
    few = df.where(F.col(n) <= COPIES).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    runs_ = F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div {COPIES}"))
    many = df.where(F.col(n) > COPIES).withColumn("run_", F.explode(runs_)).repartition("run_")
    many = many.withColumn(copy, F.explode(F.sequence(F.col("run_") * COPIES, F.least(F.col(n), (F.col("run_") + 1) * COPIES) - 1))).drop("run_")
    return few.unionByName(many)


class Mix:
    """A mix of ``docs``: ``sources``, ``documents`` (each with its place in its source's stream) and ``slots``."""

    def __init__(self, docs: DataFrame, seed: int = 7, block: int = 128, per_shard: int = 8192, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source"):
        spark = docs.sparkSession
        ship(spark)
        self.block = block
        alike = ["source", "salt", "doc_id", "size", "mark"]
        base = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), *self.marks(text))
        base = base.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(SALTS)).cast("int"))
        base = cut(base.groupBy(*alike).agg(F.count("*").alias("n")), "mix")
        parts = base.groupBy("source", "salt").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
        rows = parts.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        sizes = {r["source"]: r["size"] for r in rows}
        goal = targets(sizes, weights, share, most)
        table, quotas = [], []
        for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
            words = min(int(goal[s] + 1e-6), int(most * sizes[s]))
            slots, off = quota(sizes[s], words, block, seed, i)
            quotas.append(slots)
            table.append((s, i, sizes[s], goal[s], -(-sizes[s] // block), off))
        kind = docs.schema[source].dataType.simpleString()
        self.sources = spark.createDataFrame(table, f"source {kind}, s int, source_size long, target double, n_blocks long, off long")
        told = F.broadcast(self.sources.select(F.col("source").alias("source_"), "s", "source_size", "target"))  # a row a source
        inner = Window.partitionBy("source").orderBy("salt")
        before = parts.select(F.col("source").alias("source_"), F.col("salt").alias("salt_"), (F.sum("size").over(inner) - F.col("size")).alias("before"))
        all_ = F.col("size") * F.col("n")
        order = Window.partitionBy("source", "salt").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = base.withColumn("within", F.sum(all_).over(order) - all_).join(before, F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))).drop("source_", "salt_")
        placed = copies(placed.join(told, F.col("source").eqNullSafe(F.col("source_"))).drop("source_"))
        self.documents = placed.withColumn("start", F.col("before") + F.col("within") + F.col("copy") * F.col("size")).drop("before", "within", "salt", "n")
        self.slots = self._slots(spark, np.asarray(quotas, np.int64), np.asarray([t[4] for t in table], np.int64), np.asarray([t[5] for t in table], np.int64), per_shard, seed)

    @staticmethod
    def marks(text: str) -> list:
        """A document's words, and a hash that tells documents of one id apart."""
        words = F.coalesce(F.col(text), F.lit(""))
        return [F.regexp_count(words, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(words).alias("mark")]

    @staticmethod
    def _slots(spark, quotas: np.ndarray, blocks: np.ndarray, off: np.ndarray, per_shard: int, seed: int) -> DataFrame:
        """shard, slot, source number s, block, and the words that the slot leaves off: a row for each slot of the mix."""
        shards = -(-int(quotas.sum()) // per_shard)

        def rows(cols: dict[str, list]) -> dict:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
            for shard in cols["id"]:
                before, counts = shard_counts(quotas, per_shard, shard, seed)
                made = []
                for s in np.flatnonzero(counts).tolist():
                    k, n = np.arange(before[s], before[s] + counts[s]), int(blocks[s])
                    for turn in range(int(k[0]) // n, int(k[-1]) // n + 1):
                        own = k[k // n == turn]
                        left = np.where(own == quotas[s] - 1, off[s], 0)
                        made.append(np.stack([np.full(len(own), s), permuted(own % n, n, pass_key(seed, s, turn)), left]))
                both = np.concatenate(made, axis=1)
                both = both[:, np.random.default_rng((seed, shard)).permutation(both.shape[1])]
                for col, v in zip(out, (np.full(both.shape[1], shard), np.arange(both.shape[1]), *both), strict=True):
                    col.append(v)
            return {n: np.concatenate(c) for n, c in zip(("shard", "slot", "s", "block", "off"), out, strict=True)}

        ids = spark.range(0, shards, 1, max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 16))))
        return arrow_map(ids, rows, "shard long, slot long, s int, block long, off long")

    def pieces(self) -> DataFrame:
        """Each document's part of each block of its stream: lo and hi count its words. Documents without words are in no block."""
        b, end = F.lit(self.block), F.col("start") + F.col("size")
        own = F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))
        return self.documents.where("size > 0").withColumn("block", F.explode(own)).withColumns({
            "lo": F.greatest(F.col("block") * b, F.col("start")) - F.col("start"),
            "hi": F.least((F.col("block") + 1) * b, end) - F.col("start"),
        })

    def _kept(self) -> Column:
        """Where a piece ends in a slot that leaves off the last ``off`` words of its block."""
        ends = F.least((F.col("block") + 1) * F.lit(self.block), F.col("source_size")) - F.col("off")
        return F.greatest(F.col("lo"), F.least(F.col("hi"), ends - F.col("start")))

    def taken(self) -> DataFrame:
        """The pieces with ``times``, how often the mix takes their block, and ``kept``, where they end in the last of these slots."""
        # Without the hint the planner takes the slots for as few as the shards that they come from, and broadcasts them.
        times = self.slots.groupBy("s", "block").agg(F.count("*").alias("times"), F.max("off").alias("off")).hint("merge")
        both = self.pieces().join(times, ["s", "block"], "left").withColumns({"times": F.coalesce("times", F.lit(0)), "off": F.coalesce("off", F.lit(0))})
        return both.withColumn("kept", self._kept())

    def by_document(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: words that the mix takes of each document, repeats counted."""
        words = (F.col("hi") - F.col("lo")) * F.col("times") - F.when(F.col("times") > 0, F.col("hi") - F.col("kept")).otherwise(0)
        found = self.taken().groupBy("doc_id", "s", "mark", "start", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
        empty = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        names = ("doc_id", "size", "source_size", "target", "taken")
        return found.select(*names).unionByName(empty.select(*names))

    def layout(self) -> DataFrame:
        """shard, slot, doc_id, lo, hi: the mix itself, as word ranges of documents in each slot's block."""
        both = self.slots.hint("merge").join(self.pieces(), ["s", "block"]).withColumn("hi", self._kept())
        return both.where("hi > lo").select("shard", "slot", "doc_id", "lo", "hi")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix as documents with the columns of ``docs``: the words taken at least once of each document, and again those taken twice, and so on; ``n_chars`` is counted anew."""
    mix = Mix(docs, key=key, text=text, source=source, **settings)
    turns = mix.taken().where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    turns = turns.withColumn("hi", F.when(F.col("turn") == F.col("times"), F.col("kept")).otherwise(F.col("hi"))).where("hi > lo")
    ranges = turns.groupBy("doc_id", "s", "mark", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    names = mix.sources.select(F.col("source").alias("source_"), F.col("s"))
    place = lambda k, src, mark: F.xxhash64(k, src, mark)
    rest = [c for c in docs.columns if c != text]
    held = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias(free_name("_", rest))).alias("row")
    whole = docs.select(held, F.col(text).alias("text"), F.col(key).alias("key"), F.col(source).alias("source"), *Mix.marks(text)).where("size > 0")
    whole = whole.select(place("key", "source", "mark").alias("id"), "key", "source", "mark", F.lit(0).cast("long").alias("start"), F.lit(0).alias("turn"), "row", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("ranges"))
    ranges = ranges.join(F.broadcast(names), "s").select(
        place("doc_id", "source_", "mark").alias("id"), F.col("doc_id").alias("key"), F.col("source_").alias("source"), "mark", "start", "turn",
        F.lit(None).cast(whole.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("text"), "ranges",
    )
    # Texts and their ranges are dealt and sorted as one table, so that they meet in one pass: of rows that repeat a document
    # entirely, the n-th text comes before the ranges of the n-th place, and no two lists are compared.
    alike = Window.partitionBy("id", "key", "source", "mark", F.col("turn") == 0).orderBy("start")
    dealt = whole.unionByName(ranges).repartition("id")
    dealt = dealt.withColumn("nth", F.when(F.col("turn") == 0, F.row_number().over(alike)).otherwise(F.dense_rank().over(alike)))
    dealt = dealt.sortWithinPartitions("id", "key", "source", "mark", "nth", "turn").select("row", "text", "ranges")
    word = re.compile(WORD)
    row = whole.schema["row"].dataType.simpleString()

    def cutted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the text that ranges of the next batch may belong to
        for batch in batches:
            for part in runs(batch, "text"):
                if last is not None:
                    part = pa.concat_batches([last, part])
                own = part.column("ranges").is_null().to_numpy(zero_copy_only=False)
                at = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
                picked, out, seen, starts = [], [], -1, []
                for i in np.flatnonzero(~own).tolist():
                    if at[i] != seen:
                        seen = int(at[i])
                        t = part.column("text")[seen].as_py()
                        starts = [*(m.start() for m in word.finditer(t)), len(t)]
                    picked.append(seen)
                    out.append("".join(t[starts[r["lo"]] : starts[r["hi"]]] for r in part.column("ranges")[i].as_py()))
                last = part.take(pa.array([int(at[-1])]))  # a copy, so that the batch can go
                if out:
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(picked)), pa.array(out, pa.string())], names=["row", "mixed"])

    mixed = dealt.mapInArrow(cutted, f"row {row}, mixed string")
    new = {text: F.col("mixed"), "n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return mixed.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
