"""The prefix trie of conversations, by pre-order intervals.

A node is a sequence of turns with which conversations begin. Nobody holds a whole path: each turn becomes two numbers of its digest and place, and their running sums along a
conversation name its prefixes. Sorted by these names, the members of a node stand together, and the first of them, which has the least id, names the node from there on.

Conversations are ranked lexicographically: two are compared by the node at which they part, that with the lesser least member coming first. A conversation's nodes have few different least
members (k of them need k other conversations of 1, 2, ... k turns, so k is at most the root of twice the number of all turns), and the places where they change are its key. Then the
members of a node stand in a row in this order, its least member first, and nodes sorted by the rank of their least member and by depth are in pre-order. With running sums along
it, what is in a node's subtree is the sum up to where its last member ends, less the sum before the node: the interval is found by a join, not by a walk.

All running sums are those of ``scans``: over ranges of sorted rows with what one partition hands to the next, so a conversation, a node or the tree may be of any size. Joins of turns or nodes with their
conversation go by pieces of PIECE depths, so none of them has a hot key. An end's digest is the one thing that has to read a node's ids in turn, as SHA-256 can't be split: they are
joined in pieces where they lie, and the pieces of a node stream through one task.

Defined results: a null role or text is an empty one; null turns come first; turns of one number go by role, then by the SHA-256 of role and text; repeated rows are turns of their own; rows with a
null conv_id belong to no conversation and are left out; negative ids round towards zero; texts of any length count whole; other columns are ignored, whatever their names; an empty table gives no rows.
Prefixes are told apart by 120 bits of SHA-256 sums: different ones of a depth fall together with a probability of 2 ** -120 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, ship
from .scans import Scan, scanned

#: Conversations of one hundred share the first turns of its first: less than SHARED of them, by a checksum of the id.
HUNDRED = 100
SHARED = 6
#: Depths of a conversation that one key of a join holds.
PIECE = 128
#: Bytes of joined ids in a row.
JOINED_BYTES = 64 << 10


def _whole(n: int) -> Column:
    return F.lit(n).cast("long")


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns in order: c, base, other, h (turns taken from the base), pos from 1, base_len (turns of the base, complete in rows of others), digest, size (code points)."""
    c, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = c - c % HUNDRED
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        base.alias("base"), (c != base).cast("long").alias("other"), c.alias("c"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.char_length(text).cast("long").alias("size"), (F.crc32(c.cast("string").cast("binary")) % SHARED).alias("h"), (c == base).cast("long").alias("is_base"), _whole(1).alias("one"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["base", "other", "c", "turn", "role", "digest", "tie"]
    out = scanned(turns, order, [Scan(("base", "other", "c"), {"pos": "one"}), Scan(("base",), {"base_len": "is_base"})], "turns")
    return out.select("c", "base", "other", "h", "pos", "base_len", "digest", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (c, depth from 1, digest, size), and how many each has (c, n_turns; 0 too)."""
    turns = _numbered(conversations)
    kept = F.least("h", "base_len")
    of = turns.groupBy("c", "base", "other", "h").agg(F.max("pos").alias("n"), F.max("base_len").alias("base_len"))
    length = F.when(F.col("other") == 0, F.col("n")).otherwise(kept + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(of.select("c", "base", "other", "h", length.alias("n_turns")), "conversations")
    own = turns.where("other = 0 OR pos > h").select("c", F.when(F.col("other") == 0, F.col("pos")).otherwise(F.col("pos") - F.col("h") + kept).alias("depth"), "digest", "size")
    heads = turns.where((F.col("other") == 0) & (F.col("pos") < SHARED)).select(F.col("base").alias("b"), F.col("pos").alias("depth"), "digest", "size")
    # Some two hundred ids at most have one base, and a base has five heads at most.
    taken = convs.where("other = 1").join(heads, (F.col("base") == F.col("b")) & (F.col("depth") <= F.col("h"))).select("c", "depth", "digest", "size")
    return own.unionByName(taken), convs.select("c", "n_turns")


def _number(digest: Column, k: int) -> Column:
    """60 bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")


def _least_members(turns: DataFrame) -> DataFrame:
    """c, depth, size and m, the least conversation that begins with the same turns up to there."""
    placed = F.sha2(F.concat_ws(":", "depth", "digest").cast("binary"), 256)
    named = turns.select("c", "depth", "size", placed.alias("p")).select("c", "depth", "size", _number(F.col("p"), 0).alias("f0"), _number(F.col("p"), 1).alias("f1"))
    named = scanned(named, ["c", "depth"], [Scan(("c",), {"p0": "f0", "p1": "f1"})], "prefixes").drop("f0", "f1")
    return scanned(named, ["depth", "p0", "p1", "c"], [Scan(("depth", "p0", "p1"), firsts={"m": "c"})], "members").drop("p0", "p1")


def _sortable(x: Column) -> Column:
    """A long as text in its order."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _ranked(members: DataFrame, convs: DataFrame, least: int) -> DataFrame:
    """c, n_turns, rank in lexicographic order, and of the nodes that c is the least member of: ``top``, the depth of the first (n_turns + 1: there is none), and ``above``, the least member of its parent."""
    root = convs.select("c", _whole(least).alias("m"), _whole(0).alias("depth"))
    end = convs.select("c", F.col("c").alias("m"), (F.col("n_turns") + 1).alias("depth"))  # each conversation ends with a mark of its own
    changes = members.select("c", "m", "depth").unionByName(root).unionByName(end).groupBy("c", "m").agg(F.min("depth").alias("d"), F.max("depth").alias("e"))
    paths = changes.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("path"), (F.max("e") - 1).alias("n_turns"))
    key = F.array_join(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda s: F.concat(_sortable(-s["d"]), _sortable(s["m"]))), "")
    last = F.element_at("path", -1)
    rows = paths.select("c", "n_turns", last["d"].alias("top"), F.get("path", F.size("path") - 2)["m"].alias("above"), key.alias("key"), _whole(1).alias("one"))
    return scanned(rows, ["key"], [Scan((), {"rank": "one"})], "ranks").drop("key", "one")


def _pieces(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE))).alias("piece")


def _end_digests(ranked: DataFrame) -> DataFrame:
    """m, depth and the digest of the ids of the conversations that end at a node."""
    ends = ranked.select(F.when(F.col("top") <= F.col("n_turns"), F.col("c")).otherwise(F.col("above")).alias("m"), F.col("n_turns").alias("depth"), "c")
    ship(ends.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def row(h: dict) -> tuple:
            return h["node"][0], h["node"][1], h["first"], ",".join(h["ids"])

        for batch in batches:
            out = []
            for m, d, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held is None or held["node"] != (m, d) or held["bytes"] > JOINED_BYTES:
                    if held:
                        out.append(row(held))
                    held = {"node": (m, d), "first": c, "ids": [], "bytes": 0}
                held["ids"].append(str(c))
                held["bytes"] += len(held["ids"][-1]) + 1
            yield rows_of(out)
        if held:
            yield rows_of([row(held)])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["m", "depth", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["m", "depth", "ends_sha256"])
        for batch in batches:
            out = []
            for m, d, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node == (m, d):
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (m, d), hashlib.sha256()
                sha.update(ids.encode())
            yield made(out)
        if node:
            yield made([(*node, sha.hexdigest())])

    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = ends.repartitionByRange(parts, "m", "depth", "c").sortWithinPartitions("m", "depth", "c").mapInArrow(joined, "m long, depth long, first long, ids string")
    return some.repartition("m", "depth").sortWithinPartitions("m", "depth", "first").mapInArrow(digested, "m long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its interval in pre-order, position and end_position."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    n, least = convs.agg(F.count("*"), F.min("c")).first()
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, position long, end_position long")
    members = _least_members(turns)
    ranked = _ranked(members, convs, least)

    nodes = members.groupBy("m", "depth").agg(F.count("*").alias("n_convs"), F.max("size").alias("size"))
    root = convs.groupBy(_whole(least).alias("m"), _whole(0).alias("depth")).agg(F.count("*").alias("n_convs"), _whole(0).alias("size"))
    nodes = nodes.unionByName(root).withColumn("piece", F.floor(F.col("depth") / PIECE))
    chains = ranked.where("top <= n_turns").select(F.col("c").alias("m"), "rank", "top", "above", _pieces(F.col("top"), F.col("n_turns")))
    nodes = nodes.join(chains.hint("merge"), ["m", "piece"])
    nodes = cut(nodes.select("m", "depth", "n_convs", "size", "rank", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("m")).alias("parent")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.hint("merge"), ["m", "depth"], "left").withColumn("n_children", F.coalesce("n_children", _whole(0)))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("size"), "one": _whole(1), "is_end": _whole(0)}).drop("size")
    ends = ranked.select("rank", (F.col("n_turns") + 1).alias("depth"), _whole(0).alias("leaf"), _whole(0).alias("saving"), _whole(0).alias("one"), _whole(1).alias("is_end"))
    along = scanned(nodes.unionByName(ends, allowMissingColumns=True), ["rank", "depth"], [Scan((), {"position": "one", "leaves": "leaf", "saved": "saving"})], "preorder")

    # A node's last member stands n_convs - 1 after its least; its end is where the subtree ends.
    stops = along.where("is_end = 1").select(F.col("rank").alias("last"), F.col("position").alias("end_position"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"), _pieces(_whole(0), F.col("depth")))
    nodes = along.where("is_end = 0").withColumns({"last": F.col("rank") + F.col("n_convs") - 1, "piece": F.floor(F.col("depth") / PIECE)})
    done = nodes.join(stops.hint("merge"), ["last", "piece"]).join(_end_digests(ranked).hint("merge"), ["m", "depth"], "left")
    return done.select(
        F.col("m").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("all_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("all_saved") - F.col("saved") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "position", "end_position",
    )


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda v, s: list_reduce(list_prepend(xor(v, s), range(8)), lambda w, i: CASE WHEN w % 2 = 1 THEN xor(w // 2, 3988292384) ELSE w // 2 END)), 4294967295)"

#: DuckDB SQL for the contract's columns: nodes as lists of turns, subtrees by comparing them.
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS l FROM t GROUP BY c),
k AS (SELECT c, c - c % {HUNDRED} AS b, {_CRC} % {SHARED} AS h FROM o),
built AS (SELECT k.c, coalesce(b.l[:h], []) || o.l[h + 1:] AS l FROM k JOIN o ON o.c = k.c LEFT JOIN o AS b ON b.c = k.b),
p AS (SELECT c, len(l) AS n, l[:d] AS p, d FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM built)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends, (count(*) - 1) * coalesce(length(any_value(p)[d].x), 0) AS saving FROM p GROUP BY p, d),
u AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(u.n_children, 0) AS n_children FROM n LEFT JOIN u ON n.p = u.p)
SELECT a.conv_id, a.d::BIGINT AS depth, (SELECT conv_id FROM n WHERE a.d > 0 AND n.p = a.p[:a.d - 1]) AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM w AS a JOIN (SELECT a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saving)::BIGINT AS saved_tokens FROM n AS a JOIN w AS b ON b.d >= a.d AND b.p[:a.d] = a.p GROUP BY a.p) AS s ON s.p = a.p
"""
