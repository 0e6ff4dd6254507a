"""Package documents in expressions against the container reader."""

import pytest
from pyspark.sql import functions as F

from quire.functions.package import package_tables
from quire.sources.container import read_tables
from tests.test_books import MTIME, as_dicts, basic, writer

_START = '<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid">'
_DC = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
ITEMS = '<manifest><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml" properties=" nav  x "/><item id="c" href="c.jpg" media-type="image/jpg"/><note/><item href="d"/></manifest>'
SPINE = '<spine toc="n" page-progression-direction="rtl"><itemref idref="a" linear="no"/><itemref idref="gone"/></spine>'
META = f'<metadata {_DC}><dc:identifier id="uid">u</dc:identifier><dc:title>T &amp; t</dc:title><dc:language/><meta name="cover" content="c"/><dc:creator opf:role="aut" xmlns:opf="http://www.idpf.org/2007/opf" xml:lang="en">A<![CDATA[<b>]]></dc:creator></metadata>'
TEXTS = {
    "plain": f"{_START}{META}{ITEMS}{SPINE}</package>",
    "guide": f"<?xml version='1.0'?><!-- c -->{_START}{META}{ITEMS}{SPINE}<guide><reference type='text' title='&lt;' href='a#b'/><reference/></guide><bindings><mediaType handler='h' media-type='m'/></bindings></package>",
    "broken": f"{_START}{META}{ITEMS}{SPINE.replace('</spine>', '')}</package>",
    "stray": f"{_START}{META.replace('</metadata>', '</stray>a & b < c</metadata>')}{ITEMS}{SPINE}</package> tail",
    "no spine": f"{_START}{META}{ITEMS}</package>",
    "no metadata": f"{_START}{ITEMS}{SPINE}</package>",
    "no manifest": f"{_START}{META}{SPINE}</package>",
    "twice": f"{_START}{META.replace('<dc:title>', '<dc:title>first</dc:title><dc:identifier id=\'uid\'>v</dc:identifier><dc:title>')}{ITEMS}{SPINE}</package>",
}


def expected(text):
    """The tables by the container reader, on a book of that package alone."""
    files = {"META-INF/container.xml": b'<container><rootfiles><rootfile media-type="application/oebps-package+xml" full-path="x.opf"/></rootfiles></container>', "x.opf": text.encode()}

    def read(name):
        return files.get(name, b"<html><body/></html>")

    return read_tables("b", read, content=False)


def test_packages_are_what_the_reader_reads(spark):
    built = {"written": as_dicts(basic())}
    texts = TEXTS | {k: writer.package(b, writer.datetime.fromisoformat(MTIME), writer.OPTIONS).decode() for k, b in built.items()}
    df = spark.createDataFrame(list(texts.items()), "book string, text string").repartition(3)
    got = {t: {k: [] for k in texts} for t in package_tables(df)}
    for t, table in package_tables(df).items():
        assert "MapInArrow" not in table._jdf.queryExecution().toString()
        for r in table.collect():
            got[t][r.book].append(r)
    for name, text in texts.items():
        try:
            want = expected(text)
        except Exception as e:
            assert [(r.error_code, r.error) for r in got["books"][name]] == [(-1, str(e))] and not any(got[t][name] for t in got if t != "books")
            continue
        rows = lambda t, key: sorted(got[t][name], key=lambda r: r[key])
        assert [(r.seq, r.ns, r.name, r.value, [tuple(a) for a in r.attrs]) for r in rows("metadata", "seq")] == [w[1:] for w in want["metadata"]], name
        assert [(r.pos, r.kind, r.id, r.file_name, r.media_type, r.is_linear, r.media_overlay, r.media_duration, r.properties) for r in rows("items", "pos")] == [(*w[1:7], *w[11:14]) for w in want["items"]], name
        assert [(r.pos, r.idref, r.linear) for r in rows("spine", "pos")] == [w[1:] for w in want["spine"]], name
        assert [(r.pos, r.href, r.title, r.type) for r in rows("guide", "pos")] == [w[1:5] for w in want["guide"]], name
        assert [(r.pos, r.attrs) for r in rows("bindings", "pos")] == [w[1:] for w in want["bindings"]], name
        b = got["books"][name][0]
        assert (b.version, b.identifier_id, b.uid, b.title, b.language, b.direction, b.error) == (*want["books"][0][1:7], None), name


def test_empty_texts_have_no_package(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "no markup")], "book string, text string")
    t = package_tables(df)
    assert {r.error for r in t["books"].collect()} == {"no element found"} and t["items"].count() == 0
    assert package_tables(df.where(F.lit(False)))["metadata"].count() == 0


@pytest.mark.parametrize("levels", [5_000])
def test_deep_packages(spark, levels):
    text = f"{_START}<metadata>{'<x>' * levels}deep{'</x>' * levels}</metadata>{ITEMS}{SPINE}</package>"
    t = package_tables(spark.createDataFrame([("a", text)], "book string, text string"))
    assert [(r.name, r.value) for r in t["metadata"].collect()] == [("x", None)] and t["spine"].count() == 2
