"""Books that can't be read, what is read of those that can, and writing that commits."""

import io
import os
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quire.plans.book import Book, Item, Section, corpus
from quire.plans.reading import DAMAGE, damaged
from quire.schemas import TABLES
from quire.sources import entries as E
from quire.sources import reader, writer
from quire.sources.container import Archive, nav_nodes, ncx_nodes, read_tables

MTIME = "2024-05-15T12:00:00+02:00"


def book(name="book", size=20):
    b = Book(name, "uid", f"Title of {name}", "en")
    b.add_item(Item("html", id="one", file_name="p1.xhtml", title="One", content="<body><p>" + "text " * 500 + "</p></body>"))
    b.add_item(Item("image", id="big", file_name="big.png", media_type="image/png", content=os.urandom(size)))
    b.add_item(Item("nav"))
    b.spine = ["one"]
    return b


def packed(spark, *books, options=None):
    return {r.book: bytes(r.data) for r in writer.pack(corpus(spark, list(books)), {"mtime": MTIME, **(options or {})}).collect()}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """A book in every state, in a folder."""
    data, path = packed(spark, book())["book"], tmp_path_factory.mktemp("library")
    for kind in DAMAGE:
        (path / f"x{kind}.epub").write_bytes(damaged(data, kind))
    return str(path)


def told(rows):
    return {os.path.basename(r.book)[1:].removesuffix(".epub"): (r.error_code, r.error) for r in rows}


WANT = {k: (None if not k else 0 if k == "zip" else -1, v.format("EPUB/p1.xhtml") or None) for k, v in DAMAGE.items()}


def test_every_way_of_reading_tells_the_same(spark, library, tmp_path):
    from quire.streaming.ingest import ingest

    reader.register(spark)
    got = reader.read_corpus(spark, library)
    assert told(got.books.collect()) == WANT == told(got.staged().books.collect())
    wrong = {k: v for k, v in WANT.items() if k}
    assert told(got.quarantine.collect()) == wrong == told(got.staged().quarantine.collect())
    source = lambda t, **o: spark.read.format("epub").options(table=t, **o).load(library)
    assert told(source("books").collect()) == WANT and told(source("quarantine").collect()) == wrong
    ingest(spark, library, f"{tmp_path}/out", f"{tmp_path}/state", ("books",)).awaitTermination(120)
    assert told(spark.read.parquet(f"{tmp_path}/out/books").collect()) == WANT and told(spark.read.parquet(f"{tmp_path}/out/quarantine").collect()) == wrong
    got.save(f"{tmp_path}/saved")
    assert told(spark.read.parquet(f"{tmp_path}/saved/quarantine").collect()) == wrong
    # A table that inflates nothing knows of damaged entries all the same, and no table has rows of such a book.
    for t in TABLES:
        if t != "books":
            assert {os.path.basename(r.book) for r in getattr(got, t).select("book").distinct().collect()} <= {"x.epub"} >= {os.path.basename(r.book) for r in source(t).select("book").distinct().collect()}


def test_modes(spark, library):
    reader.register(spark)
    for t in ("books", "spine", "items", "quarantine"):
        column = reader.read_corpus(spark, library, corrupt="said")
        rows = getattr(column, t).collect()
        if t != "quarantine":
            assert {os.path.basename(r.book)[1:].removesuffix(".epub"): r.said for r in rows if r.said} == {k: v[1] for k, v in WANT.items() if k}
            again = spark.read.format("epub").options(table=t, corrupt="said").load(library)
            assert again.columns == getattr(column, t).columns and sorted(map(str, (r.said for r in again.collect()))) == sorted(map(str, (r.said for r in rows)))
        dropped = getattr(reader.read_corpus(spark, library, mode="DROPMALFORMED"), t).select("book").distinct().count()
        assert dropped == (len(WANT) - 1 if t == "quarantine" else 1)
    for kind in ("damaged", "secret", "odd", "gone", "zip"):
        for run in (lambda p: reader.read_corpus(spark, p, mode="FAILFAST").spine.collect(), lambda p: spark.read.format("epub").options(table="spine", mode="FAILFAST").load(p).collect()):
            with pytest.raises(Exception, match=WANT[kind][1].split(" ")[-1]):
                run(f"{library}/x{kind}.epub")
    # Without contents entries are looked up, not read: of the states, only damage isn't seen.
    light = told(reader.read_corpus(spark, library, content=False).books.collect())
    assert light == WANT | {"damaged": (None, None)} == told(spark.read.format("epub").options(table="books", content="false").load(library).collect())


@pytest.mark.parametrize("levels", [1, 3, 2_000])
def test_navigation_of_any_depth(levels):
    b = book()
    b.add_item(Item("ncx"))
    node = Section("s0", "p1.xhtml")
    for k in range(1, levels):
        node = (Section(f"s{k}", "p1.xhtml" if k % 2 else ""), [node, Section(f"t{k}", "p1.xhtml#t")])
    rows = []
    stack = [(node, ())]
    while stack:  # rows of the nested lists, without recursion here too
        n, path = stack.pop()
        head, kids = n if isinstance(n, tuple) else (n, [])
        rows.append({"path": [0, *path], "parent_path": [0, *path][:-1], "depth": len(path) + 1, "node_kind": "section" if kids else "link", "title": head.title, "href": head.href, "uid": head.title})
        stack += [(k, (*path, i)) for i, k in reversed(list(enumerate(kids)))]
    from tests.test_books import as_dicts

    made = as_dicts(b) | {"toc": rows}
    with zipfile.ZipFile(io.BytesIO(writer.build(made, {"mtime": MTIME}))) as z:
        ncx, nav = ncx_nodes(z.read("EPUB/toc.ncx")), nav_nodes(z.read("EPUB/nav.xhtml"), "")
    want = [(r["depth"] - 1, r["title"]) for r in rows]
    assert [(d, t) for d, t, *_ in ncx] == want == [(d, t) for d, t, *_ in nav]
    assert [h for _, _, h, _, _ in nav] == [r["href"] for r in rows]


class Counting(io.FileIO):
    """A file that counts what is read of it."""

    count = 0

    def readinto(self, b):
        n = super().readinto(b)
        Counting.count += n
        return n

    def read(self, *a):
        out = super().read(*a)
        Counting.count += len(out)
        return out


def test_tables_read_little_of_a_book(spark, tmp_path, monkeypatch):
    data = packed(spark, book(size=3_000_000))["book"]
    (tmp_path / "a.epub").write_bytes(data)
    assert len(data) > 3_000_000
    monkeypatch.setattr(Counting, "count", 0)
    rows = read_tables("a", Archive(Counting(tmp_path / "a.epub")), content=False)
    assert [r[2] for r in rows["spine"]] == ["one"] and Counting.count < 8_000
    # The data source opens files so, too.
    opened = lambda self, path: Counting(path)
    own = reader._Reader({"path": str(tmp_path), "table": "spine", "content": "false"}, spark.createDataFrame([], TABLES["spine"]).schema)
    monkeypatch.setattr(reader, "_file_system", lambda path: (type("Fs", (), {"open_input_file": opened, "get_file_info": lambda self, p: reader.pafs.LocalFileSystem().get_file_info(p)})(), path, ""))
    Counting.count = 0
    assert [b.num_rows for b in own.read(reader._Books([str(tmp_path / "a.epub")]))] == [1] and Counting.count < 8_000
    # So does the index, and single entries are read by their own bytes.
    monkeypatch.setattr(E, "open_file", lambda path: Counting(path))
    Counting.count = 0
    index = E.entries_of("a", lambda: Counting(tmp_path / "a.epub"))
    assert len(index) == 6 and Counting.count < 2_000
    e = dict(zip([c.split()[0] for c in E.ENTRIES.split(", ")], next(x for x in index if x[2].endswith("p1.xhtml")), strict=True))
    Counting.count = 0
    with Counting(tmp_path / "a.epub") as f:
        assert b"text text" in E._inflated(f, e) and Counting.count < 1_000


def test_entry_index_and_reads(spark, library):
    index = E.entry_index(E.book_files(spark, library))
    reader.register(spark)
    source = spark.read.format("epub").option("table", "entries").load(library)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, index.collect())) == sorted(map(key, source.collect()))
    assert {os.path.basename(r.book): r.error for r in index.where("name IS NULL").collect()} == {"xzip.epub": "Bad Zip file"}
    done = E.read_entries(index.withColumn("mine", F.lit(7))).collect()
    assert {r.mine for r in done} == {7}
    assert {(os.path.basename(r.book), r.name, r.error) for r in done if r.error and r.name} == {(f"x{k}.epub", "EPUB/p1.xhtml", f"EPUB/p1.xhtml is {w}") for k, w in (("damaged", "damaged"), ("secret", "encrypted"), ("odd", "compressed in an unknown way"))}
    with zipfile.ZipFile(f"{library}/x.epub") as z:
        assert {r.name: bytes(r.content) for r in done if r.book.endswith("/x.epub")} == {n: z.read(n) for n in z.namelist()}
    assert E.read_entries(index.where("false")).count() == 0
    with pytest.raises(Exception, match="Bad Zip"):
        E.entry_index(E.book_files(spark, library), mode="FAILFAST").collect()
    assert E.entry_index(E.book_files(spark, library), mode="DROPMALFORMED").where("name IS NULL").count() == 0


def test_items_fetch_their_contents(spark, library):
    light, whole = reader.read_corpus(spark, library, content=False), reader.read_corpus(spark, library)
    index = E.entry_index(E.book_files(spark, library))
    wanted = light.items.where("kind = 'image'").unionByName(light.items.where("kind = 'nav'").withColumn("file_name", F.lit("./sub/../nav.xhtml"))).unionByName(light.items.where("kind = 'html'").limit(1).withColumn("file_name", F.lit("gone.xhtml")))
    got = E.with_content(wanted, light.books, index).collect()
    want = {(r.kind): bytes(r.content) for r in whole.items.collect()}
    assert {bytes(r.content) for r in got if r.kind == "image"} == {want["image"]} and {bytes(r.content) for r in got if r.kind == "nav"} == {want["nav"]}
    assert [(r.content, r.error) for r in got if r.kind == "html"] == [(None, "Can not find gone.xhtml")]


def test_writes_commit(spark, tmp_path):
    good, wrong = book("a/one"), book("b/two")
    wrong.add_item(Item(id="w", file_name="x" * 70_000, content=b"y"))
    both = corpus(spark, [good, wrong])
    files = lambda p: sorted(f.relative_to(p).as_posix() for f in p.rglob("*") if f.is_file())
    with pytest.raises(ValueError, match="b/two"):
        writer.write_books(both, f"file://{tmp_path}/strict", {"mtime": MTIME})
    assert files(tmp_path / "strict") == [] if (tmp_path / "strict").exists() else True
    done = writer.write_books(both, f"{tmp_path}/loose", {"mtime": MTIME, "raise_exceptions": False})
    rows = {r.book: r for r in done.collect()}
    assert files(tmp_path / "loose") == ["a/one.epub"] and rows["a/one"].bytes == (tmp_path / "loose/a/one.epub").stat().st_size and rows["a/one"].error is None
    assert rows["b/two"].error_code == -1 and rows["b/two"].error and rows["b/two"].bytes is None
    assert writer.write_corpus(both, f"{tmp_path}/loose", {"mtime": MTIME, "raise_exceptions": False}) == 1
    # Names that can't be are told in the same way.
    twice = replace(corpus(spark, [good]), **{t: df.unionByName(df.withColumn("book", F.lit("/a/one.epub"))) for t, df in corpus(spark, [good]).tables().items()})
    told = writer.write_books(twice, f"{tmp_path}/twice", {"mtime": MTIME, "raise_exceptions": False}).collect()
    assert len(told) == 2 and all("one name" in r.error for r in told) and files(tmp_path / "twice") == []


def test_no_container_is_shuffled(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(writer, "written", lambda df, name, own=writer.written: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, name))
    writer.write_books(corpus(spark, [book()]), str(tmp_path), {"mtime": MTIME})
    # Above the pass that builds containers nothing joins or deals rows.
    assert len(seen) == 1 and seen[0].lstrip().startswith("MapInArrow") and seen[0].count("MapInArrow") == 1


def test_sink_commits_parts(spark, tmp_path):
    reader.register(spark)
    rows = spark.createDataFrame([(f"f{k % 3}/b{k}", d) for k in range(9) for d in packed(spark, book()).values()], "book string, data binary").repartition(3)
    sink = lambda df, mode: df.write.format("epub").mode(mode).save(f"file://{tmp_path}/out")
    sink(rows, "append")
    out = tmp_path / "out"
    found = lambda: sorted("/".join(f.relative_to(out).parts[1:]) for f in out.rglob("*.epub"))
    assert found() == sorted(f"f{k % 3}/b{k}.epub" for k in range(9)) and all(p.name.startswith("part-") for p in out.iterdir())
    assert spark.read.format("epub").option("table", "books").load(str(out)).count() == 9
    (out / "_attempts-lost").mkdir()
    (out / "_attempts-lost" / "half.epub").write_bytes(b"PK")
    assert spark.read.format("epub").option("table", "books").load(str(out)).count() == 9 == reader.read_corpus(spark, str(out)).books.count()
    (out / "note.txt").write_text("stays")
    sink(rows.limit(2), "overwrite")
    assert len([f for f in found() if "half" not in f]) == 2 and (out / "note.txt").exists()
    with pytest.raises(Exception, match="one name"):
        sink(rows.limit(1).unionByName(rows.limit(1)).coalesce(1), "append")
    assert len([f for f in found() if "half" not in f]) == 2
    with pytest.raises(Exception, match="leads out"):
        sink(rows.limit(1).withColumn("book", F.lit("../x")), "append")
