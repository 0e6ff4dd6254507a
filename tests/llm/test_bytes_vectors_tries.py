"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bytebpe, prefixtrie, queries, scans, whitening

BYTES = queries.tokenizer("byte_bpe_50k.json")


# 11. whitening


def brute_whitening(rows, k=4):
    fine = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if fine(v)]
    d = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (d - len(v))) for i, v in good]
    fit = sorted({tuple(v) for _, v in good})
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(d)]
    own = lambda v: np.array([(n * a - b) / n for a, b in zip(v, sums, strict=True)])
    x = np.array([own(v) for v in fit])
    cov = x.T @ x / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return [(i, c + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, sums, strict=True)), float(own(v) @ u[:, c] / math.sqrt(e[c])), e[c] / np.trace(cov)) for i, v in good for c in range(min(k, d))]


def same_whitening(got, want):
    order = lambda r: (r[1], r[0] is not None, r[0] or 0, r[3])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for c in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9
    assert all(g[5] == pytest.approx(w[5], rel=1e-9) for g, w in zip(got, want, strict=True))
    assert all(0 <= g[6] < 1e-9 for g in got)


def test_whitening(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(7)]) for i in range(60)]
    rows += [rows[3]] * 40 + [(None, rows[4][1]), (70, rows[5][1]), (71, rows[6][1][:3])]
    rows += [(80, None), (81, [1.0, None]), (82, [float("nan")] * 7), (83, [float("-inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7).withColumns({c: F.lit(1) for c in ("x", "n", "dev", "component")})
    floats = df.select("vec_id", "embedding").collect()
    same_whitening(whitening.whitened(df).collect(), brute_whitening(floats))
    assert whitening.whitened(df.where("false")).count() == 0 == whitening.whitened(df.where("vec_id = 3")).count()


def test_whitening_of_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same_whitening(queries.QUERIES["op11_embedding_whitening"](spark, sf_dir).collect(), brute_whitening(table.select("vec_id", "embedding").collect()))


def test_whitening_at_the_ends(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 0.5]), (3, [0.25]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.k_: r.x for r in whitening.whole_numbers(df).collect()} == {1: [(1 << 63) - 1, 256], 2: [-(1 << 63), 128], 3: [64], 4: []}
    got = {(r.vec_id, r.component): r for r in whitening.whitened(df).collect()}
    assert got[1, 1].deviation is None and abs(got[1, 1].whitened) == pytest.approx(math.sqrt(2)) and {c for _, c in got} == {1}  # the other's variance is rounding beside this one
    assert whitening._sums(spark.createDataFrame([([-5, 1 << 62],), ([2, 1 << 62],), ([-(1 << 63), 7],)], "x array<long>"), 2) == [-3 - (1 << 63), (1 << 63) + 7]


# 12. byte-level BPE


@pytest.fixture(scope="module")
def both():
    return bytebpe.ByteBpe(BYTES), Tokenizer.from_file(BYTES)


#: Words, marks, white space, contractions, letters of several scripts, unassigned and new characters, parts of the special token.
PARTS = ["a", "b", " ", "the", "e", "é", "ab", "\n", "1", "22", "’", "'s", "'ll", "ſ", "漢", "՘", "₏", "\U0001f600", " ing", "tion", "...", "<|endoftext|>", "<|", "|>", "aaaa", "A", "\t", "\r\n", " ", "\x00", "‍"]


@pytest.mark.parametrize("seed", range(4))
def test_byte_bpe_is_the_librarys(both, seed):
    own, library = both
    rng = random.Random(seed)
    tokens = [t for t in own.texts if t]
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) + b"".join(rng.choice(tokens).encode("latin-1") for _ in range(rng.randrange(6))).decode("utf-8", "replace")
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False), repr(text)


def test_byte_bpe_decodes_any_ids(both):
    own, library = both
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([-1, 64, 1 << 40])) == "a"


def test_byte_bpe_of_one_long_piece(both, monkeypatch):
    own, library = both
    rng = random.Random(2)
    for text in ("a" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "é漢" * 5_000, " " * 9_999 + "x"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    # Tables that fill and texts that are cut change nothing.
    text = " ".join(rng.choice(PARTS) for _ in range(4_000))
    for name in ("TABLE_PAIRS", "TABLE_PIECES", "SPLIT_CHARS", "DECODE_IDS"):
        monkeypatch.setattr(bytebpe, name, 7)
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_unusable_tokens_are_never_answers(both):
    own, library = both
    for i, text in enumerate(own.texts):
        if text and i % 5 == 0:
            kept = text in own.single or own.found.exists(text)
            letters = {b: c for c, b in bytebpe.byte_letters().items()}
            assert kept == ([t.id for t in library.model.tokenize("".join(letters[ord(c)] for c in text))] == [i])


def test_byte_bpe_query(spark, both):
    rows = [(1, "The the\n\n it's"), (1, "The the\n\n it's"), (2, None), (3, ""), (None, "x<|endoftext|>y"), (4, "word " * 20_000 + "é" * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("ids", "k_", "t_", "n_tokens")})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = lambda t: both[1].encode(t or "", add_special_tokens=False).ids
    want = sorted((repr(i), len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or "")) for i, t in rows)
    assert sorted((repr(r[0]), *r[1:]) for r in bytebpe.round_trip(df, BYTES).collect()) == want
    assert bytebpe.round_trip(df.where("false"), BYTES).count() == 0
    back = bytebpe.decoded(spark.createDataFrame([(1, [64, None, 65, 99_999]), (2, None)], "doc_id long, ids array<int>"), BYTES)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "ab", 2: ""}


def test_byte_bpe_of_whole_table(spark, both, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = both[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 13. the prefix trie


def brute_trie(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            given[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in given.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1]) if p else 0) + sum(saved[k] for k in below[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(repr((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(below[p]), leaves[p], saved[p], sha(c for c in m if len(built[c]) == len(p)))) for p, m in members.items())


def trie_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(30), 100, 101, 102, 150, 207, 300, -3, -100, -102]:
        rows += [(c, t, rng.choice(["u", None]), rng.choice(["a", "b", "é", None, ""])) for t in range(rng.choice([1, 2, 3, 7]))]
    rows += [(205, 0, "a", "x"), (55, None, "u", "z"), (55, None, "u", "z"), (55, 3, "q", "a"), (None, 1, "u", "x"), (56, 1, "u", "x"), (56, 1, "u", "x"), (56, 1, "u", "y")]
    return rows + [(57, i, "u", "a") for i in range(300)] + [(58, i, "u", "a") for i in range(200)] + [(59, i, "u", "ab"[i % 2]) for i in range(150)] + [(c, 0, "same", "turn") for c in range(400, 480)]


@pytest.fixture(scope="module")
def trie(spark):
    df = spark.createDataFrame(trie_rows(), "conv_id long, turn long, role string, text string").repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("c", "base", "depth", "m", "h", "n_turns")})


def test_prefix_trie(spark, trie):
    done = prefixtrie.prefix_trie(trie)
    got = done.collect()
    assert sorted(repr(tuple(r)[:8]) for r in got) == brute_trie(trie_rows())
    # Positions are a pre-order: a node's interval holds those of its children, which follow it one after the other.
    node = {(r.conv_id, r.depth): r for r in got}
    assert sorted(r.position for r in got) == list(range(1, len(got) + 1))
    below = defaultdict(list)
    for r in got:
        if r.depth:
            below[r.parent_conv_id, r.depth - 1].append(r)
    for k, r in node.items():
        at = r.position
        for kid in sorted(below[k], key=lambda x: x.position):
            assert kid.position == at + 1
            at = kid.end_position
        assert at == r.end_position
    assert prefixtrie.prefix_trie(trie.where("false")).count() == 0 == prefixtrie.prefix_trie(trie.where("conv_id IS NULL")).count()


def test_prefix_trie_in_small_pieces(trie, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    monkeypatch.setattr(prefixtrie, "JOINED_BYTES", 5)
    assert sorted(repr(tuple(r)[:8]) for r in prefixtrie.prefix_trie(trie).collect()) == brute_trie(trie_rows())


def test_prefix_trie_sql(spark, trie):
    con = duckdb.connect()
    conversations = trie.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations WHERE conv_id <> 57 OR turn < 60")
    want = con.execute(prefixtrie.ORACLE).fetchall()
    got = prefixtrie.prefix_trie(trie.where("conv_id <> 57 OR turn < 60")).drop("position", "end_position").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_scans_pass_over_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.choice([1, -1, (1 << 62), 1 << 61])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(4)
    got = scans.scanned(df, ["g", "i"], [scans.Scan(("g",), {"s": "v"}, {"f": "i"}), scans.Scan((), {"all": "v"})], "scan").collect()
    sums, first, total, wrap = defaultdict(int), {}, 0, lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    want = []
    for g, i, v in sorted(rows):
        sums[g], total = sums[g] + v, total + v
        want.append((g, i, v, wrap(sums[g]), first.setdefault(g, i), wrap(total)))
    assert sorted(map(tuple, got)) == want
    plan = scans.scanned(df, ["g", "i"], [scans.Scan((), {"s": "v"})], "scan")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
