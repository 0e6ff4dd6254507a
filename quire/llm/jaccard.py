"""Similarity join on word shingles with Bayesian pruning.

Every text gets a MinHash signature (80 values of 16 bits over its five-word shingles). Texts that agree on four values in a
row, in any of 20 bands, are candidates: a pair at similarity 0.8 is missed with probability (1 - 0.8**4)**20 < 3e-5 before other
pairs of its group are considered. A candidate's values are then compared 16 at a time, and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold (uniform prior) is below ``tolerance``. What stays is verified exactly on the sets of shingles.

How it stays linear in rows: equal texts are one class. A bucket of candidates is worked on in tiles of bounded size, and a tile
gives a spanning forest of what it finds, not pairs. The forests' components bound all that can be linked, so exact
verification needs each text's shingles once (in tiles again where a component is large), considers every pair of the component, also those that no band brought
together, and returns for each text the number of documents linked and its tile's root. A bucket or component of any size is whole; only its work is split. Counting
every link of T different texts of one component takes T * T / 2 comparisons (most of them end at the first 16 values or in a matrix product), and moves each text T / TILE times:
linear in rows while groups of *different* near copies are small, quadratic in the largest of them. Equal texts cost nothing, whatever their number.

Free style: signatures and tiles are Arrow maps, grouping and joins DataFrame operations. Hot texts, buckets and components meet in aggregations that combine before the shuffle, or in joins whose large side adaptive execution splits.

Stars of the components are split by salted minima (``components.py``), so no node is too frequent for a task.

Words are runs of other than white space (0x20, 0x09-0x0D), as they are. A text of one to four words has one shingle of all of them. Defined results: a null text is empty;
texts without words equal only texts of the same bytes; rows that repeat a document are documents of their own; a row with a null key is in its text's class, whose id is the least key in the
group or null if there is none; a text of any length is compared whole; ties for the least key or root change nothing, as ids of classes are keys; other columns are ignored, whatever their names; an empty table gives no rows. Shingles, and texts
after equal ones are joined by 128 bits of SHA-256, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, runs, ship
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 80
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
#: Texts a side of a tile, and shingles a side when sets are compared.
TILE = 512
TILE_SHINGLES = 1 << 21
#: Shingles of a tile that are counted at a time, and pairs that are compared at a time.
RANGE = 1 << 18
PAIRS = 1 << 16
#: Bytes of text whose arrays are held at a time.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.random.default_rng(20240901).integers(1, 1 << 63, (HASHES, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``texts`` in turn (repeats included), and the n + 1 places where texts begin."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    base = int(ends[0])
    raw = np.frombuffer(data, np.uint8, int(ends[-1]) - base, base) if data else np.empty(0, np.uint8)
    ends = ends - base
    word = ~_SPACE[raw]
    before = np.concatenate(([False], word[:-1]))
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False]))
    after[ends[1:][ends[1:] > 0] - 1] = False
    stops = np.flatnonzero(word & ~after) + 1
    with np.errstate(over="ignore"):
        powers = np.full(len(raw) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * powers[:-1], out=sums[1:])
        back = np.full(len(raw) + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        hashes = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
        del powers, sums, back
        first = np.searchsorted(starts, ends)  # of each text's words
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(1, n - (SHINGLE - 1)))
        place = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(place[-1]) + np.repeat(first[:-1] - place[:-1], count)
        size = np.repeat(np.minimum(n, SHINGLE), count)
        out = size.astype(np.uint64)
        for k in range(SHINGLE):
            own = hashes[np.minimum(at + k, max(0, len(hashes) - 1))] if len(hashes) else hashes
            out = np.where(k < size, mixed(out * np.uint64(31) + own), out)
    return out, place


def signatures(found: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A row of HASHES 16-bit values for each text that has shingles."""
    starts = place[:-1][np.diff(place) > 0]
    out = np.empty((len(starts), HASHES), "<u2")
    if not len(starts):
        return out
    buffer = np.empty_like(found)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(_FACTORS):
            np.multiply(found, a, out=buffer)
            np.bitwise_xor(buffer, b, out=buffer)
            least = np.minimum.reduceat(buffer, starts)
            out[:, i] = (mixed(least) >> np.uint64(48)).astype("<u2")
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal values for which P(similarity >= threshold | values) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is the probability of at most m successes in n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


class Pruner:
    def __init__(self, threshold: float, tolerance: float):
        self.steps = [(k, min(k + STEP, HASHES)) for k in range(0, HASHES, STEP)]
        self.need = [least_matches(hi, threshold, tolerance) for _, hi in self.steps]

    def pairs(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (a[i], b[j]) that no step drops."""
        equal = np.zeros(len(i), np.int64)
        for (lo, hi), need in zip(self.steps, self.need, strict=True):
            equal += (a[i, lo:hi] == b[j, lo:hi]).sum(1)
            keep = equal >= need
            i, j, equal = i[keep], j[keep], equal[keep]
        return i, j

    def all_pairs(self, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs between ``a`` and ``b`` (within ``a`` if ``same``) that stay, a block of rows at a time."""
        out: list[list[np.ndarray]] = [[], []]
        rows = max(1, PAIRS // max(1, len(b)))
        for lo in range(0, len(a), rows):
            i, j = np.divmod(np.arange(min(rows, len(a) - lo) * len(b)), len(b))
            i += lo
            if same:
                i, j = i[i < j], j[i < j]
            i, j = self.pairs(a, b, i, j)
            out[0].append(i)
            out[1].append(j)
        return np.concatenate(out[0] or [np.empty(0, int)]), np.concatenate(out[1] or [np.empty(0, int)])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By vertex of 0..n-1, the least vertex that the edges (i, j) connect it to."""
    label = np.arange(n)
    while len(i):
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, was[i], low)
        np.minimum.at(label, was[j], low)
        label = label[label]
        if np.array_equal(label, was):
            break
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are equal in ``keys``, several to a table, of batches that are sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            same &= col == col[last]
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut_at:
            yield table.slice(0, cut_at)
        rest = table.slice(cut_at)
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(-1, HASHES)


TILED = ["tile", "ti", "tj"]


def candidate_edges(batches: Iterator[pa.RecordBatch], pruner: Pruner) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs that pruning leaves in each tile of a bucket: rows (tile, ti, tj, side, node, sig), sorted."""
    for table in grouped(batches, TILED):
        bounds = _bounds(table, TILED)
        node, side, sig = table.column("node").to_numpy(), table.column("side").to_numpy(), _matrix(table.column("sig"))
        within = table.column("ti").to_numpy() == table.column("tj").to_numpy()
        a, b = [], []
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        i, _ = pruner.pairs(sig, sig, two, two + 1)
        a.append(node[i])
        b.append(node[i + 1])
        for lo, hi in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            same = bool(within[lo])
            if not same and mid in (lo, hi):
                continue
            i, j = pruner.all_pairs(sig[lo:mid], sig[lo:hi] if same else sig[mid:hi], same)
            root = forest(hi - lo, i, j if same else j + (mid - lo))
            own = np.flatnonzero(root != np.arange(hi - lo))
            a.append(node[lo + own])
            b.append(node[lo + root[own]])
        a, b = np.concatenate(a), np.concatenate(b)
        differ = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], names=["a", "b"])


def shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of shingles that a[i] and b[j] share, exactly."""
    if len(i) <= 4 * (len(a) + len(b)):
        out = np.empty(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            u, v = (a[x], b[y]) if len(a[x]) <= len(b[y]) else (b[y], a[x])
            at = np.searchsorted(v, u)
            out[k] = (v[np.minimum(at, len(v) - 1)] == u).sum()
        return out
    # Many pairs: count through matrices of texts and shingles, a range of shingles and some columns at a time.
    sets = [*a, *b] if a is not b else a
    total = np.zeros((len(a), len(b)), np.float32)
    wide = 4096
    parts = -(-sum(map(len, sets)) // RANGE)
    edges = np.asarray([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(parts):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in own])
        _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        column = column.reshape(-1)
        keep = times[column] > 1
        renumber = np.cumsum(times > 1) - 1
        rows, column = rows[keep], renumber[column[keep]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        columns = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, columns, wide):
            x, y = np.searchsorted(column, [lo, lo + wide])
            m = np.zeros((len(sets), min(wide, columns - lo)), np.float32)
            m[rows[x:y], column[x:y] - lo] = 1
            total += m[: len(a)] @ (m.T if a is b else m[len(a) :].T)
    return total[i, j].astype(np.int64)


def exact_links(batches: Iterator[pa.RecordBatch], pruner: Pruner, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each text of a tile of a component that is linked to others there: node, root, and the documents linked."""
    for table in grouped(batches, TILED):
        bounds = _bounds(table, TILED)
        node, side, n, sig = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("sig"))
        within = table.column("ti").to_numpy() == table.column("tj").to_numpy()
        raw = table.column("shingles")
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = int(np.searchsorted(side[lo:hi], 1))
            same = bool(within[lo])
            # Of two chunks one may be empty; the other's own pairs are those of its own tile.
            if not same and first in (0, hi - lo):
                continue
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in raw.slice(lo, hi - lo)]
            a, b = sets[:first], sets[:first] if same else sets[first:]
            if same:
                b = a
            i, j = pruner.all_pairs(sig[lo : lo + first], sig[lo:hi] if same else sig[lo + first : hi], same)
            size = np.asarray([len(s) for s in sets])
            right = j if same else j + first
            both = shared(a, b, i, j)
            near = both >= threshold * (size[i] + size[right] - both) - 1e-9
            near &= node[lo + i] != node[lo + right]
            i, right = i[near], right[near]
            links = np.zeros(hi - lo, np.int64)
            np.add.at(links, i, n[lo + right])
            np.add.at(links, right, n[lo + i])
            root = forest(hi - lo, i, right)
            own = np.flatnonzero(links)
            for col, v in zip(out, (node[lo + own], node[lo + root[own]], links[own]), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["node", "root", "links"])


def digest(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, digest (16 bytes), n_shingles (repeats included) and sig (null without words) of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text", CHUNK):
                found, place = shingles(part.column("text"))
                count = np.diff(place)
                made = iter(signatures(found, place))
                sig = [next(made).tobytes() if c else None for c in count.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(count), pa.array(sig, pa.binary())], names=["doc_id", "digest", "n_shingles", "sig"])

    src = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).alias("text"))
    return src.mapInArrow(rows, "doc_id long, digest binary, n_shingles long, sig binary")


def tiled(df: DataFrame, parts: Column, tile: str) -> DataFrame:
    """Rows of ``df`` in the tiles of their group ``tile``: its members fall into ``parts`` chunks by hash, and every two chunks meet in one tile."""
    df = df.withColumn("parts", parts.cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("parts")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = df.withColumns({
        "tile": F.col(tile), "ti": F.least("chunk", "other"), "tj": F.greatest("chunk", "other"), "side": (F.col("chunk") > F.col("other")).cast("int"),
    })
    return out.drop("parts", "chunk", "other")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(*TILED).sortWithinPartitions(*TILED, "side", "node")


def linked(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id and digest, with rep_id (least key of its text's class), class_id (least key of all documents
    connected by links), n_links (other documents at ``threshold`` or more) and ``component``, a number that its group alone has."""
    ship(docs.sparkSession)
    pruner = Pruner(threshold, tolerance)
    all_ = cut(signed(docs, key, text), "signed")
    node = F.xxhash64("digest")
    classes = cut(all_.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n"), F.any_value("sig").alias("sig"), F.max("n_shingles").alias("n_shingles")).withColumn("node", node), "classes")

    # Buckets of candidates: first which of them have two texts or more, then their members with signatures.
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(HASHES // ROWS)])
    buckets = classes.where("sig IS NOT NULL").select("node", F.explode(bands).alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1")
    members = buckets.join(full, "bucket").join(classes.select("node", "sig"), "node")
    edges = _dealt(tiled(members, F.ceil(F.col("texts") / TILE), "bucket").select(*TILED, "side", "node", "sig")).mapInArrow(lambda it: candidate_edges(it, pruner), "a long, b long")
    loose = cut(components(edges, "candidates"), "loose")

    # Exact verification, a component of candidates at a time.
    sizes = loose.join(classes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("all_shingles"))
    wanted = loose.join(classes.select("node", F.col("digest").alias("digest_"), "n", "sig"), "node").join(sizes, "root")
    wanted = wanted.select("node", "digest_", "n", "sig", F.col("root").alias("group"), F.greatest(F.ceil(F.col("texts") / TILE), F.ceil(F.col("all_shingles") / TILE_SHINGLES)).alias("parts_"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text", CHUNK):
                found, place = shingles(part.column("text"))
                made = [np.unique(found[x:y]).astype("<u8").tobytes() for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "n", "sig", "group", "parts_")), pa.array(made, pa.large_binary()).cast(pa.binary())], names=["node", "n", "sig", "group", "parts_", "shingles"])

    # One text a class, whatever its keys: equal texts combine before the shuffle.
    texts = docs.select(digest(text).alias("digest"), F.col(text).alias("text")).groupBy("digest").agg(F.any_value("text").alias("text"))
    told = wanted.join(texts, F.col("digest") == F.col("digest_"))
    told = told.select("node", "n", "sig", "group", "parts_", "text").mapInArrow(sets, "node long, n long, sig binary, group long, parts_ long, shingles binary")
    tiles = _dealt(tiled(told, F.col("parts_"), "group").select(*TILED, "side", "node", "n", "sig", "shingles"))
    exact = cut(tiles.mapInArrow(lambda it: exact_links(it, pruner, threshold), "node long, root long, links long"), "links")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    named = classes.select("node", "rep_id").join(roots, "node").join(links, "node", "left")
    ids = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    found = named.join(ids, "root").select(F.col("node").alias("node_"), "root", "class_id", "links")
    known = classes.select("digest", "node", "rep_id", "n").join(found, F.col("node") == F.col("node_"), "left").drop("node_")
    return all_.select("doc_id", "digest").join(known, "digest").select(
        "doc_id", "digest", "rep_id",
        F.coalesce("class_id", "rep_id").alias("class_id"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("root", "node").alias("component"),
    )


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id, n_links and rep_id of every document."""
    return linked(docs, **settings).select("doc_id", "class_id", "n_links", "rep_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group that with the least key (then digest; of rows that are alike in both, one)."""
    firsts = linked(docs, key=key, text=text, **settings).groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    firsts = firsts.select(F.coalesce(F.col("first.doc_id"), F.lit(-(1 << 62))).alias("k_"), F.col("first.digest").alias("d_"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("k"), digest(text).alias("d"))
    # Rows that repeat a document fall to one a task before they are dealt, and not after.
    nth = F.row_number().over(Window.partitionBy("k", "d").orderBy(F.lit(1)))
    whole = whole.withColumn("nth", nth).where("nth = 1")
    return whole.join(firsts, (F.col("k") == F.col("k_")) & (F.col("d") == F.col("d_")), "left_semi").select("row.*")
