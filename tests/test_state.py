"""Trees without paths, accumulation over batches, tables laid out for lookups, and the table function."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import catalogue as K
from quire.operators.navigation import preorder, spine_rows
from quire.plans.book import corpus
from quire.sources import reader, writer
from quire.sources.tablefunction import register_function
from quire.streaming import accumulate as A
from tests.test_reading import MTIME, book


def brute(rows):
    """Numbers and depths by a walk, and what can't be reached."""
    out, ids = {}, {(b, i): (p, o) for b, i, p, o in rows}
    kids = {}
    for b, i, p, o in rows:
        kids.setdefault((b, p), []).append((o, i))
    for b in {r[0] for r in rows}:
        n, stack = 0, [(i, 1) for _, i in sorted(kids.get((b, None), []), reverse=True)]
        while stack:
            i, d = stack.pop()
            n += 1
            out[b, i] = (n, d, None)
            stack += [(k, d + 1) for _, k in sorted(kids.get((b, i), []), reverse=True)]
    for b, i, _, _ in rows:
        if (b, i) not in out:
            seen, at = set(), i
            while at not in seen and (b, at) in ids:
                seen.add(at)
                at = ids[b, at][0]
            out[b, i] = (None, None, "cycle" if at in seen else "orphan")
    return out


def test_preorder_numbers(spark):
    rng = random.Random(1)
    rows = [("r", k, rng.randrange(k) if k and rng.random() < 0.95 else None, rng.randrange(5)) for k in range(400)]
    rows += [("chain", k, k - 1 if k else None, 0) for k in range(3_000)] + [("one", 1, None, 0), ("lost", 1, 9, 0), ("lost", 2, 1, 0), ("lost", 3, 9, 0), ("lost", 4, None, 2)]
    rows += [("odd", 1, 3, 0), ("odd", 2, 1, 0), ("odd", 3, 2, 0), ("odd", 4, 1, 1), ("odd", 5, 5, 0), ("odd", 6, None, 0), ("odd", 7, 6, 0)]
    got = preorder(spark.createDataFrame(rows, "book string, id int, parent int, ord int"))
    assert {(r.book, r.id): (r.number, r.depth, r.error) for r in got.collect()} == brute(rows)
    assert preorder(spark.createDataFrame([], "book string, id int, parent int, ord int")).count() == 0


def batches(spark, tmp_path, rows, schema, cuts, run, mode, merge):
    """``run`` over a stream of the rows in batches that are cut there; ``merge`` takes each batch."""
    src, k = tmp_path / "in", 0
    src.mkdir(parents=True)
    out = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.STORE)
    try:
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(src))
            query = run(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(merge(df))).option("checkpointLocation", str(tmp_path / "state"))
            query.trigger(availableNow=True).start().awaitTermination(300)  # a stream is restarted for each batch
            k += 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


@pytest.mark.parametrize("cuts", [[], [1, 5, 6]])
def test_ids_go_on_over_batches(spark, tmp_path, cuts):
    kinds = ["html", "image", "html", "item", "html", "image", "html", "nav", "html"]
    rows = [(b, n, k, "given" if n == 4 else None) for n, k in enumerate(kinds) for b in ("x", "y")]
    schema = "book string, pos long, kind string, id string"
    got = batches(spark, tmp_path, rows, schema, cuts, A.auto_ids, "append", lambda df: df.collect())
    want = K.auto_ids(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted((r.book, r.pos, r.kind, r.id) for r in want) and got[0].asDict().keys() == {"book", "pos", "kind", "id"}


def test_authors_and_unique_entries_go_on(spark, tmp_path):
    rows = [("x", n, "own" if n == 2 else None) for n in range(6)]
    schema = "book string, seq long, uid string"
    got = batches(spark, tmp_path / "authors", rows, schema, [2, 3], A.author_ids, "append", lambda df: df.collect())
    assert sorted((r.seq, r.id) for r in got) == sorted((r.seq, r.id) for r in K.author_ids(spark.createDataFrame(rows, schema)).collect())
    rng = random.Random(2)
    writes = [(rng.choice("xy"), n, rng.choice(["title", "language", "identifier"]), f"v{n}") for n in range(30)]
    schema = "book string, seq long, name string, value string"
    merged = {}
    batches(spark, tmp_path / "unique", writes, schema, [3, 11, 12], A.unique_entries, "update", lambda df: merged.update({(r.book, r.name): r.value for r in df.collect()}) or [])
    assert merged == {(r.book, r.name): r.value for r in K.set_unique(spark.createDataFrame(writes, schema), ["book", "name"], ["seq"]).collect()}


def test_tables_for_lookups(spark, tmp_path):
    made = corpus(spark, [book("a"), book("b")])
    made.save_tables(str(tmp_path), "shelf_", buckets=4)
    own = reader.corpus_of_tables(spark, "shelf_")
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        done = spine_rows(own.spine, own.items)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
        assert sorted((r.book, r.idref, r.found) for r in done.collect()) == [("a", "one", True), ("b", "one", True)]
    finally:
        for k in settings:
            spark.conf.unset(k)
        for t in own.tables():
            spark.sql(f"DROP TABLE shelf_{t}")


def test_table_function(spark, tmp_path):
    writer.write_corpus(corpus(spark, [book("a"), book("b")]), str(tmp_path), {"mtime": MTIME})
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    corpus_, files = reader.read_corpus(spark, str(tmp_path)), reader.containers(spark, str(tmp_path))
    files.createOrReplaceTempView("files_")
    register_function(spark)
    for t in ("books", "metadata", "items", "spine", "quarantine"):
        got = spark.sql(f"SELECT * FROM read_books(TABLE(files_), '{t}')")
        want = getattr(corpus_, t)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for wrong in ("SELECT * FROM read_books(TABLE(files_), 'nothing')", "SELECT * FROM read_books(TABLE(SELECT 1 AS x), 'toc')"):
        with pytest.raises(Exception, match="read_books reads"):
            spark.sql(wrong)


def test_streams_of_books(spark, tmp_path):
    """Books that arrive are read once, also over restarts, and as many at a time as asked for; batches write parts."""
    import os

    reader.register(spark)
    data = bytes(writer.pack(corpus(spark, [book()]), {"mtime": MTIME}).first().data)
    seen = []

    def run(**options):
        stream = spark.readStream.format("epub").options(table="books", path=str(tmp_path / "in"), **options).load()
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append((n, sorted(os.path.basename(r.book) for r in df.select("book").collect())))).option("checkpointLocation", str(tmp_path / "state"))
        return query

    def arrive(*names):
        (tmp_path / "in").mkdir(exist_ok=True)
        for k, n in enumerate(names):
            (tmp_path / "in" / n).write_bytes(data if "bad" not in n else b"x")

    arrive("a.epub", "b.epub", "bad.epub")
    for _ in range(2):  # a restart reads nothing again
        run().trigger(availableNow=True).start().awaitTermination(120)
    assert [b for _, b in seen if b] == [["a.epub", "b.epub", "bad.epub"]]
    arrive("c.epub", "note.txt")
    run().trigger(availableNow=True).start().awaitTermination(120)
    assert [b for _, b in seen if b][1:] == [["c.epub"]]
    seen.clear()
    fresh = run(max_books="2").option("checkpointLocation", str(tmp_path / "other")).start()
    try:
        fresh.processAllAvailable()
        arrive("d.epub", "e.epub", "f.epub")
        fresh.processAllAvailable()
    finally:
        fresh.stop()
    sizes = [len(b) for _, b in seen if b]
    assert sizes[0] == 4 and max(sizes[1:]) <= 2 and sum(sizes) == 7 and len({x for _, b in seen for x in b}) == 7
    spark.createDataFrame([(f"k{n}", data) for n in range(3)], "book string, data binary").write.parquet(str(tmp_path / "packed"))
    packed = spark.readStream.schema("book string, data binary").parquet(str(tmp_path / "packed"))
    for _ in range(2):
        packed.writeStream.format("epub").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "sink")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.epub")) == ["k0.epub", "k1.epub", "k2.epub"] and not list((tmp_path / "out").glob("_*"))
    assert spark.read.format("epub").option("table", "books").load(str(tmp_path / "out")).where("error IS NULL").count() == 3


def test_deep_trees_as_text(spark):
    """Text of a chain of ten thousand levels, and of a tree of many shapes, as a walk writes it."""
    from quire.operators.navigation import nav_text, ncx_text

    rng, rows = random.Random(6), [("chain", k, k + 1, f"i{k}", f"t{k}", "" if k % 3 else f"h{k}") for k in range(10_000)]
    depth = 0
    for k in range(500):
        depth = rng.randrange(1, depth + 2)
        rows.append(("shapes", k, depth, f"i{k}", "<&>", rng.choice(["", 'x"y'])))
    df = spark.createDataFrame(rows, "book string, number long, depth int, nav_id string, title string, href string")
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    want_nav, want_ncx = {}, {}
    for name in ("chain", "shapes"):
        nav, ncx, open_ = [], [], 0
        for _, _, d, i, t, h in (r for r in rows if r[0] == name):
            if d > open_:
                nav.append("<ol>")
            else:
                nav += ["</li>", *["</ol></li>"] * (open_ - d)]
                ncx += ["</navPoint>"] * (open_ - d + 1)
            open_ = d
            nav.append(f'<li><a href="{esc(h)}">{esc(t)}</a>' if h else f"<li><span>{esc(t)}</span>")
            ncx.append(f'<navPoint id="{i}"><navLabel><text>{esc(t)}</text></navLabel><content src="{esc(h)}"/>')
        want_nav[name], want_ncx[name] = "".join([*nav, "</li>", *["</ol></li>"] * (open_ - 1), "</ol>"]), "".join([*ncx, *["</navPoint>"] * open_])
    assert {r.book: r.text for r in nav_text(df).collect()} == want_nav
    assert {r.book: r.text for r in ncx_text(df.withColumnRenamed("href", "src")).collect()} == want_ncx
