"""Books authored, written, read back: the reference's fixtures rebuilt, over containers."""

import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.dom import parse_html
from quire.operators import catalogue as K
from quire.operators import documents as D
from quire.operators import hooks
from quire.plans.book import Book, Item, Link, Section, corpus
from quire.sources import reader, writer
from quire.sources.container import BookError, archive_reader, folder_reader, read_tables

MTIME = "2024-05-15T12:00:00+02:00"


def basic(ncx: bool = True) -> Book:
    b = Book("basic", "test123456", "Test book", "en")
    b.add_author("Test Author")
    b.set_cover("image.jpg", b"fake bytes")
    b.add_item(Item(id="style", file_name="style.css", media_type="text/css", content=b"body{}"))
    one = b.add_item(Item("html", id="chap_1", file_name="test.xhtml", title="One", content='<html><head><title>old</title></head><body><h1>First</h1><p>See<a epub:type="noteref" href="#fn01">1</a></p><aside epub:type="footnote" id="fn01"><p>note</p></aside></body></html>'))
    two = b.add_item(Item("html", id="chap_2", file_name="test2.xhtml", title="Two", content="<html><body><p>Second</p><aside epub:type='endnote'>end</aside></body></html>"))
    if ncx:
        b.add_item(Item("ncx"))
    b.add_item(Item("nav"))
    b.toc = [one, (Section("Sect"), [two])]
    b.spine = ["nav", one, two]
    return b


def rows_of(book: Book, **options) -> dict:
    data = writer.build(as_dicts(book), {"mtime": MTIME, **options})
    return read_tables("b", archive_reader(data)), data


def as_dicts(book: Book) -> dict:
    from quire.schemas import TABLES

    rows = book.rows()
    names = lambda t: [c.split()[0] for c in __import__("re").split(r", (?=\w+ \w)", TABLES[t])]
    out = {t: [dict(zip(names(t), r, strict=True)) for r in rs] for t, rs in rows.items()}
    for m in out["metadata"]:
        m["attrs"] = [{"k": k, "v": v} for k, v in m["attrs"]]
    return out["books"][0] | {t: v for t, v in out.items() if t != "books"}


@pytest.mark.parametrize("ncx", [True, False])
def test_round_trip_of_a_book(spark, tmp_path, ncx):
    made = corpus(spark, [basic(ncx)])
    assert writer.write_corpus(made, f"file://{tmp_path}", {"mtime": MTIME}) == 1 and [p.name for p in tmp_path.iterdir()] == ["basic.epub"]
    with zipfile.ZipFile(tmp_path / "basic.epub") as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED)
        assert "2024-05-15T10:00:00Z" in z.read("EPUB/content.opf").decode()
    got = reader.read_corpus(spark, str(tmp_path))
    book = got.books.first()
    assert (book.title, book.uid, book.language, book.error_code) == ("Test book", "test123456", "en", None)
    toc = [(r.node_kind, r.title, r.href) for r in got.toc.orderBy("path").collect()]
    assert toc == [("link", "One", "test.xhtml"), ("section", "Sect", ""), ("link", "Two", "test2.xhtml")]
    assert {r.linear for r in got.spine.collect()} == {"yes"}
    counts = {r.item_type: r["count"] for r in K.with_type(got.items).groupBy("item_type").count().collect()}
    assert counts.pop(C.NAVIGATION, 0) == int(ncx)
    assert counts == {C.DOCUMENT: 4, C.STYLE: 1, C.COVER: 1}
    assert K.get_metadata(got.metadata, "DC", "identifier").first().value == "test123456"
    assert K.item_with_id(got.items, "chap_1").first().file_name == "test.xhtml"
    assert b"First" in K.item_with_href(got.items, "test.xhtml").first().content


def test_ncx_when_asked_for(spark):
    raw = writer.build(as_dicts(basic()), {"mtime": MTIME})
    toc = read_tables("b", archive_reader(raw), ignore_ncx=False)["toc"]
    assert [(r[4], r[5], r[6], r[7]) for r in toc] == [("link", "One", "test.xhtml", "chap_1"), ("section", "Sect", "test2.xhtml", None), ("link", "Two", "test2.xhtml", "chap_2")]


def test_all_options_on_and_off():
    b = basic()
    b.set_direction("ltr")
    b.guide = [{"href": "test.xhtml", "title": "Introduction", "type": "bodymatter"}, {"title": "no target", "type": "toc"}]
    on, data = rows_of(b, landmark_title="My Guide", pages_title="My Pages", package_direction=True, play_order=True)
    with zipfile.ZipFile(__import__("io").BytesIO(data)) as z:
        opf, nav, ncx = (z.read(f"EPUB/{n}").decode() for n in ("content.opf", "nav.xhtml", "toc.ncx"))
    assert 'page-progression-direction="ltr"' in opf and 'dir="ltr"' in opf and "<guide>" in opf
    assert "My Guide" in nav and "My Pages" in nav and nav.count('epub:type="bodymatter"') == 1
    assert on["page_list"][0][2:] == ("test.xhtml", "fn01", "fn01")
    assert [f'playOrder="{n}"' in ncx for n in (1, 2, 3)] == [True] * 3
    off, data = rows_of(b, epub2_guide=False, epub3_landmark=False, epub3_pages=False, spine_direction=False)
    with zipfile.ZipFile(__import__("io").BytesIO(data)) as z:
        opf, nav, ncx = (z.read(f"EPUB/{n}").decode() for n in ("content.opf", "nav.xhtml", "toc.ncx"))
    assert "ltr" not in opf and "<guide>" not in opf and "landmarks" not in nav and "page-list" not in nav and "playOrder" not in ncx


def test_data_source_reads_and_writes(spark, tmp_path):
    reader.register(spark)
    packed = writer.pack(corpus(spark, [basic()]), {"mtime": MTIME})
    packed.write.format("epub").mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("epub").option("table", "spine").load(str(tmp_path / "out"))
    assert [r.idref for r in got.orderBy("pos").collect()] == ["nav", "chap_1", "chap_2"]
    with zipfile.ZipFile(next((tmp_path / "out").glob("part-*/basic.epub"))) as z:
        z.extractall(tmp_path / "folder" / "unpacked")
    assert spark.read.format("epub").option("content", "false").load(str(tmp_path / "folder")).where("content IS NOT NULL").count() == 0
    assert spark.read.format("epub").load(str(tmp_path / "folder")).count() == 7


def test_broken_books_are_rows_or_errors(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    writer.write_corpus(corpus(spark, [basic()]), f"file://{tmp_path}", {"mtime": MTIME})
    got = reader.read_corpus(spark, str(tmp_path))
    assert sorted((r.error_code is None, r.error_code) for r in got.books.collect()) == [(False, 0), (True, None)]
    assert got.items.select("book").distinct().count() == 1
    with pytest.raises(Exception, match="Bad Zip"):
        reader.read_corpus(spark, str(tmp_path), mode="FAILFAST").books.collect()
    with pytest.raises(BookError):
        read_tables("x", archive_reader(zip_of({"META-INF/container.xml": "<container/>"})))


def zip_of(files: dict) -> bytes:
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_names_stay_in_the_folder(tmp_path):
    (tmp_path / "Text").mkdir()
    (tmp_path / "Text" / "c.xhtml").write_bytes(b"hello")
    read = folder_reader(str(tmp_path))
    assert read("Text/c.xhtml") == b"hello"
    for name in ("../../etc/passwd", "/etc/passwd"):
        with pytest.raises(OSError, match="escapes"):
            read(name)


def test_saved_tables_load_again(spark, tmp_path):
    made = corpus(spark, [basic()])
    made.save(str(tmp_path))
    again = reader.load_corpus(spark, str(tmp_path))
    assert again.items.count() == 7
    again.views("lib_")
    assert spark.sql("SELECT count(*) AS n FROM lib_items WHERE kind = 'html'").first().n == 2


@pytest.mark.parametrize(("local", "told"), [
    (datetime(2024, 5, 15, 12, tzinfo=timezone(timedelta(hours=2))), "2024-05-15T10:00:00Z"), (datetime(2024, 5, 15, 12, tzinfo=timezone.utc), "2024-05-15T12:00:00Z"),
    (datetime(2024, 5, 15, 8, 30, tzinfo=timezone(timedelta(hours=-5))), "2024-05-15T13:30:00Z"), (datetime(2024, 5, 15, 1, tzinfo=timezone(timedelta(hours=3))), "2024-05-14T22:00:00Z"),
])
def test_modified_is_utc(local, told):
    assert writer.modified(local) == told


def test_entry_time_is_not_before_1980():
    assert writer.entry_time(datetime(1975, 1, 1)) == (1980, 1, 1, 0, 0, 0)
    assert writer.entry_time(datetime(2024, 5, 15, 8, 30, 1)) == (2024, 5, 15, 8, 30, 1)


def test_item_types(spark):
    cases = [
        ("images/image_my_123.jpg", 1), ("images/image%20my%20123.jpeg", 1), ("images/image%20my%20123.png", 1), ("style/image.css", 2), ("image/image.svg", 5), ("scripts/image.js", 3), ("fonts/font.otf", 6),
        ("fonts/font.woff", 6), ("video/video.mov", 7), ("video/video.mp4", 7), ("audio/audio.mp3", 8), ("audio/audio.ogg", 8), ("smil/document.smil", 11),
    ]
    from quire.functions import items as I

    got = spark.createDataFrame(cases, "f string, t int").select("f", "t", I.type_by_extension("f").alias("x")).collect()
    assert all(r.t == r.x for r in got)


def test_plugins():
    def attrs(content):
        return [e.attrs for e in parse_html(content).walk() if e.name == "a"]

    assert attrs(D.clean(b'<body><p><a href="x" onclick="y">t</a><font color="red">z</font></p></body>')[0]) == [{"href": "x"}]
    assert b"<font" not in D.clean(b"<body><p><font>z</font></p></body>")[0]
    assert D.clean(b"<body><p><img src='http://x/y.png'/><svg viewBox='0 0 1 1'></svg></p></body>")[1] == ["remote-resources", "svg"]
    assert b'<svg width="1"></svg>' in D.clean(b"<body><p><svg viewBox='0 0 1 1' width='1'></svg></p></body>")[0]
    assert b'<table border=""><caption>s</caption>' in D.clean(b"<body><table border='0' summary='s' bgcolor='x'><tr><td>1</td></tr></table></body>")[0]
    assert attrs(D.rewrite_links(b'<body><p><a name="test01" href="../test01">x</a><a name="test02" href="test02#something">y</a></p></body>')) == [{"href": "../test01.xhtml", "id": "test01"}, {"href": "test02.xhtml#something", "id": "test02"}]
    note = D.footnotes(b'<body><p>t<span id="InsertNoteID_1_marker1" class="InsertNoteMarker"><sup><a href="#InsertNoteID_1">1</a></sup></span></p><ol id="InsertNote_NoteList"><li id="InsertNoteID_1">prvi footnote <span id="InsertNoteID_1_LinkBacks"><sup><a href="#InsertNoteID_1_marker1">^</a></sup></span></li></ol></body>')
    asides = [e for e in parse_html(note).walk() if e.name == "aside"]
    assert [(e.attrs["id"], e.text()) for e in asides] == [("InsertNoteID_1", "prvi footnote ")] and b"NoteList" not in note
    shown, done = D.highlight_source(b"<body><pre class='source-python'>def f(): pass</pre><pre class='source-rust'>fn</pre></body>")
    assert done and [e.attrs.get("class") for e in parse_html(shown).walk() if e.name == "div"] == ["highlight"] and b"source-rust" in shown
    assert D.tidy(b"<p>x") == (3, b"<p>x") or D.tidy(b"<p>x")[0] < 3


def test_hooks_over_a_corpus(spark):
    made = corpus(spark, [basic()])

    class Seen:
        def before_write(self, c):
            return c

        def html_before_write(self, items):
            return items.withColumn("title", F.concat("title", F.lit("!")))

    out = hooks.before_write(made, [Seen(), hooks.Syntax(), hooks.DocumentLinks(), hooks.SourceHighlight(), hooks.Footnotes(), hooks.Tidy()])
    got = {r.id: r for r in out.items.collect()}
    assert got["chap_1"].title == "One!" and b"footnote" in got["chap_1"].content and got["style"].content == b"body{}"


def test_rendering():
    item = {"content": b"<html lang='hr'><head><title>source</title></head><body>lead<h1>a</h1><p>b</p></body></html>", "title": "", "lang": "", "links": [{"href": "s.css", "rel": "stylesheet", "type": "text/css"}, {"src": "x.js", "type": "text/javascript"}], "metas": [{"name": "m", "content": "c"}], "direction": "rtl"}
    html = parse_html(D.render(item, "en"))
    assert html.attrs["lang"] == "en" and html.attrs["dir"] == "rtl" and html.find("head").find("title") is None
    assert [e.name for e in html.find("head").elements()] == ["meta", "link", "script"] and [e.name for e in html.find("body").elements()] == ["h1", "p"]
    assert parse_html(D.render(item | {"title": "T", "lang": "fr"}, "en")).find("head").find("title").text() == "T"
    assert D.body_content(b"<body class='x'><p>a</p></body>") == b'<body class="x"><p>a</p></body>' and D.body_content(b"<body>text</body>") == b"" == D.body_content(None)
    assert D.pages("f", b'<body><div epub:type="x" id="i"><h2>H</h2></div><span epub:type="y" id="j" aria-label="L"></span><b epub:type="z" id="k"/></body>') == [("f", "i", "H"), ("f", "j", "L"), ("f", "k", "k")]


def test_exact_operators_over_tables(spark):
    made = corpus(spark, [basic()])
    assert [(r.file_name, r.fragment) for r in D.pages_of(made.items).collect()] == [("test.xhtml", "fn01")]
    assert {r.pos: r.heading for r in D.bodies(made.items).collect()}[3] == "First"


def test_authoring():
    b = Book("x", "u")
    for a, kw in (("First", {}), ("Second", {"file_as": "Sec", "role": "edt"}), ("Third", {"uid": "third"})):
        b.add_author(a, **kw)
    assert [o["id"] for _, o in b.get_metadata("DC", "creator")] == ["creator", "creator_1", "third"]
    b.add_metadata("DC", "subject", "Fiction")
    b.set_identifier("v")
    assert b.get_metadata("DC", "subject") == [("Fiction", {})] and [v for v, _ in b.get_metadata("DC", "identifier")] == ["v"] and b.get_metadata("none", "x") == []
    doc = b.add_item(Item("html", file_name="a.xhtml"))
    doc.add_item(Item(file_name="s.css"))
    doc.add_item(Item(file_name="s.js"))
    doc.add_item(Item(file_name="s.png"))
    assert doc.id == "chapter_0" and len(doc.links) == 2 and doc.properties == ["scripted"] and len(doc.links_of_type("text/css")) == 1
    assert b.add_item(Item("image", file_name="i.png")).id == "image_0" and b.add_item(Item(file_name="f.bin")).media_type == C.DEFAULT_MEDIA_TYPE
    b.add_prefix("a", "http://a")
    b.set_template("t", "x")
    assert b.prefixes == ["a: http://a"] and b.get_template("t") == b"x" and b.get_template("u") is None
    b.toc = [Link("a.xhtml", "A", "a"), (Section("S", "s.xhtml"), [doc])]
    assert [r[4] for r in b.rows()["toc"]] == ["link", "section", "document"]


def test_incremental_ingest(spark, tmp_path):
    from quire.streaming.ingest import ingest

    made = corpus(spark, [basic()])
    writer.write_corpus(made, f"file://{tmp_path}/in", {"mtime": MTIME})
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", ("items", "spine")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/items").count() == 7 and spark.read.parquet(f"{tmp_path}/out/spine").count() == 3


def test_names_keep_their_folders(spark, tmp_path):
    """Books of one name in different folders are all written, by either writer; two that would be one file are refused."""
    made = corpus(spark, [basic()])
    both = lambda *names: reader.Corpus(**{t: __import__("functools").reduce(lambda a, b: a.unionByName(b), [df.withColumn("book", F.lit(n)) for n in names]) for t, df in made.tables().items()})
    two = both("file:///lib/a/x.epub", "/lib/b/x.epub")
    assert writer.write_corpus(two, f"file://{tmp_path}/out", {"mtime": MTIME}) == 2
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.epub")) == ["a/x.epub", "b/x.epub"]
    assert reader.read_corpus(spark, f"{tmp_path}/out").books.count() == 2
    assert writer.write_corpus(two, f"file://{tmp_path}/out", {"mtime": MTIME}) == 2  # again, onto the same files
    with pytest.raises(ValueError, match="one name"):
        writer.write_corpus(both("/a/x.epub", "/a/x"), f"file://{tmp_path}/no", {"mtime": MTIME})
    with pytest.raises(ValueError, match="outside"):
        writer.write_corpus(both("a/../../x", "b"), f"file://{tmp_path}/no", {"mtime": MTIME})
    reader.register(spark)
    writer.pack(two, {"mtime": MTIME}).write.format("epub").mode("append").save(str(tmp_path / "sink"))
    assert sorted("/".join(p.relative_to(tmp_path / "sink").parts[1:]) for p in (tmp_path / "sink").rglob("*.epub")) == ["lib/a/x.epub", "lib/b/x.epub"]


def test_saving_opens_each_container_once(spark, tmp_path):
    writer.write_corpus(corpus(spark, [basic()]), f"file://{tmp_path}/in", {"mtime": MTIME})
    got = reader.read_corpus(spark, f"{tmp_path}/in")
    got.save(f"{tmp_path}/tables")
    again = reader.load_corpus(spark, f"{tmp_path}/tables")
    for t, df in got.tables().items():
        assert sorted(map(repr, getattr(again, t).collect())) == sorted(map(repr, df.collect())), t
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan(got.staged().items) and "content" not in plan(got.staged().items.select("book", "id")).split("ReadSchema")[1]
    renamed = __import__("dataclasses").replace(got, books=got.books.withColumn("title", F.lit("new")))
    assert renamed.staged().books.first().title == "new"
    assert reader.read_corpus(spark, f"{tmp_path}/in", content=False).items.where("content IS NOT NULL").count() == 0
    assert "PushedFilters: [LessThan(length,10)]" in plan(reader.containers(spark, f"{tmp_path}/in", where="length < 10")).replace("IsNotNull(length), ", "")


def test_data_source_packs_books_and_takes_filters(spark, tmp_path, monkeypatch):
    many = [basic() for _ in range(5)]
    for n, b in enumerate(many):
        b.name = f"d{n}/book"
    writer.write_corpus(corpus(spark, many), f"file://{tmp_path}", {"mtime": MTIME})
    reader.register(spark)
    src = spark.read.format("epub").option("table", "books")
    assert src.load(str(tmp_path)).count() == 5 and src.load(f"file://{tmp_path}").rdd.getNumPartitions() == 1
    own = reader._PushingReader({"path": str(tmp_path)}, src.load(str(tmp_path)).schema)
    monkeypatch.setattr(reader, "PARTITION_BYTES", 2 * reader.FILE_BYTES)
    assert [len(p.paths) for p in own.partitions()] == [1] * 5
    list(own.pushFilters([reader.EqualTo(("book",), f"{tmp_path}/d3/book.epub")]))
    assert [p.paths for p in own.partitions()] == [[f"{tmp_path}/d3/book.epub"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert src.option("pushdown", "true").load(str(tmp_path)).where(F.col("book") == f"{tmp_path}/d3/book.epub").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_xml_is_recovered():
    from quire.sources.container import parse_xml

    root = parse_xml(b'<?xml version="1.0"?><a xmlns="u" xmlns:p="v"><b x=1 p:y=\'2\'>t & u < w<c/><![CDATA[<raw>]]></stray><d>open</a>rest')
    assert root.tag == "{u}a" and [e.tag for e in root.iter()] == ["{u}a", "{u}b", "{u}c", "{u}d"]
    assert root[0].attrib == {"x": "1", "{v}y": "2"} and root[0].text == "t & u < w" and root[0][0].tail == "<raw>" and root[0][1].text == "open"
    assert parse_xml(b"<a>&amp;&eacute;&nope;</a>").text == "&é&nope;"
    assert parse_xml(b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>').text == "&e;"
    with pytest.raises(SyntaxError):
        parse_xml(b"no markup")


def test_walks_of_any_depth(spark):
    from quire.operators.navigation import walk

    chain = [("deep", f"n{k}", f"n{k - 1}" if k else None, k % 3) for k in range(300)]
    odd = [("odd", "a", "c", 0), ("odd", "b", "a", 0), ("odd", "c", "b", 1), ("odd", "below", "a", 2), ("odd", "lost", "nowhere", 0), ("odd", "under", "lost", 0), ("odd", "self", "self", 0), ("odd", "top", None, 4), ("odd", "kid", "top", 5)]
    rows = spark.createDataFrame(chain + odd, "book string, id string, parent string, ord int")
    got = {(r.book, r.id): r for r in walk(rows).collect()}
    assert len(got) == 309
    for k in range(300):
        assert got["deep", f"n{k}"].path == [j % 3 for j in range(k + 1)] and got["deep", f"n{k}"].depth == k + 1
    assert {i: r.error for (b, i), r in got.items() if b == "odd"} == {"a": "cycle", "b": "cycle", "c": "cycle", "below": "cycle", "self": "cycle", "lost": "orphan", "under": "orphan", "top": None, "kid": None}
    assert got["odd", "kid"].path == [4, 5] and got["odd", "a"].path is None and walk(rows.where("false")).count() == 0


def test_books_are_set_up_as_before(spark):
    """Several languages, the generator, and the scheme of a sorted name."""
    b = Book("x", "u", language="en")
    b.set_language("hr")
    b.add_metadata(None, "language", "other")
    b.add_author("First", file_as="Sorted")
    assert b.language == "hr" and [v for v, _ in b.get_metadata("DC", "language")] == ["en", "hr"] and b.get_metadata(None, "language")
    assert [a["name"] for _, a in b.get_metadata("OPF", "generator")] == ["generator"]
    assert b.get_metadata(None, "meta")[-1][1] == {"refines": "#creator", "property": "file-as", "scheme": "marc:relators"}
    b.set_template("chapter", b'<html xmlns="x" class="mine"/>')
    b.add_item(Item("html", file_name="a.xhtml", content="<p>text</p>", title="T"))
    _, data = rows_of(b)
    with zipfile.ZipFile(__import__("io").BytesIO(data)) as z:
        assert b'class="mine" lang="hr"' in z.read("EPUB/a.xhtml") and b"<p>text</p>" in z.read("EPUB/a.xhtml")


def test_slow_tidy_leaves_content_alone(tmp_path, monkeypatch):
    (tmp_path / "tidy").write_text("#!/bin/sh\nsleep 5\n")
    (tmp_path / "tidy").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{__import__('os').environ['PATH']}")
    monkeypatch.setattr(D, "TIDY_SECONDS", 0.2)
    assert D.tidy(b"<p>x") == (3, b"<p>x")


def test_tidy_gives_what_the_program_says(tmp_path, monkeypatch):
    """Its output where it ends with 0 or 1, the content where it fails; options are its arguments."""
    (tmp_path / "tidy").write_text('#!/bin/sh\necho "$@"\ncat\nexit ${TIDY_ENDS:-0}\n')
    (tmp_path / "tidy").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{__import__('os').environ['PATH']}")
    assert D.tidy(b"<p>x", char_encoding="utf8") == (0, b"--char-encoding utf8\n<p>x")
    assert D.tidy_hook({"content": b"<p>x"}) == {"content": b"--char-encoding utf8 --tidy-mark no\n<p>x"} and D.tidy_hook({"content": None})["content"].endswith(b"no\n")
    for ends, want in (("1", (1, b"\n<p>x")), ("2", (2, b"<p>x"))):
        monkeypatch.setenv("TIDY_ENDS", ends)
        assert D.tidy(b"<p>x") == want
    assert hooks.Tidy.document_after_read is D.tidy_hook is hooks.Tidy.document_before_write


def test_arrivals_by_window(spark, tmp_path):
    from quire.streaming.ingest import arrivals_by_window, arriving

    writer.write_corpus(corpus(spark, [basic()]), f"file://{tmp_path}/in", {"mtime": MTIME})
    counts = arrivals_by_window(arriving(spark, f"{tmp_path}/in"))
    run = counts.writeStream.format("memory").queryName("arrivals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.books for r in spark.table("arrivals").collect()] == [1]
