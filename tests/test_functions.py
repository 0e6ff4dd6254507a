"""Column functions against the standard library, on random inputs."""

import posixpath
from urllib.parse import unquote

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import items as I
from quire.functions import paths as P

part = st.sampled_from(["a", "b.c", "..", ".", "", "x.TXT", ".hid", "é"])
path = st.builds(lambda lead, ps: lead + "/".join(ps), st.sampled_from(["", "/", "//", "///"]), st.lists(part, max_size=6))
relative = st.lists(st.sampled_from(["a", "b", "c.d"]), min_size=1, max_size=4).map("/".join)
few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.tuples(path, path), min_size=40, max_size=80))
def test_paths(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", P.normpath("a").alias("n"), P.join("a", "b").alias("j"), P.dirname("a").alias("d"), P.extension("a").alias("e")).collect()
    for r in got:
        assert r.n == posixpath.normpath(r.a), r
        assert r.j == posixpath.join(r.a, r.b), r
        assert r.d == posixpath.dirname(r.a), r
        assert r.e == posixpath.splitext(r.a)[1].lower(), r


@few
@given(st.lists(st.tuples(relative, st.one_of(relative, st.just(""))), min_size=40, max_size=80))
def test_relative_paths(spark, pairs):
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.relpath("a", "b").alias("r")).collect():
        assert r.r == posixpath.relpath(r.a, r.b or "."), r


@few
@given(st.lists(st.text("ab+%20é /", max_size=8), min_size=30, max_size=60))
def test_url_decode(spark, links):
    import re

    whole = [x for x in links if not re.search("%(?![0-9A-Fa-f]{2})", x)]
    if whole:
        for r in spark.createDataFrame([(x,) for x in whole], "h string").select("h", P.url_decode("h").alias("d")).collect():
            assert r.d == unquote(r.h), r


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_malformed_escapes_stay(spark):
    assert one(spark, P.url_decode(F.lit("a%zz"))) == "a%zz"
    assert one(spark, P.resolve(F.lit("Text"), F.lit("../x.css"))) == "x.css"
    assert one(spark, P.resolve(F.lit("Text"), F.lit("http://a//b"))) == "http://a//b"


def test_pagebreak(spark):
    expected = '<span xmlns:epub="http://www.idpf.org/2007/ops" epub:type="pagebreak" title="page1" id="page1"'
    assert one(spark, H.pagebreak(F.lit("page1"), F.lit("label"))) == expected + ">label</span>"
    assert one(spark, H.pagebreak(F.lit("page1"))) == expected + "/>"
    assert one(spark, H.pagebreak(F.lit('a"<'), F.lit("<&>"))).endswith('id="a&quot;&lt;">&lt;&amp;&gt;</span>')


def test_attributes(spark):
    assert one(spark, I.language(F.lit(""), F.lit("en"))) == "en"
    assert one(spark, I.namespace(F.lit("DC"))) == "http://purl.org/dc/elements/1.1/"
    assert one(spark, I.prefix(F.lit("a"), F.lit("u"))) == "a: u"
    assert one(spark, I.is_chapter(F.lit("nav"))) is False
    assert one(spark, I.template(F.create_map(F.lit("nav"), F.lit("x")), "cover")) is None
    assert one(spark, I.content(F.lit(None).cast("binary"))) == b""
    assert one(spark, I.media_type_default(F.lit(""), F.lit("a.svg.gz"), encoding_wins=True)) == "gzip"
    assert one(spark, H.heading(F.lit("<h1> </h1><h2 class='x'>B <i>c</i></h2>"))) == "B c"
    assert one(spark, H.body(F.lit("<body>text</body>"))) == ""
    assert one(spark, H.rewrite_link(F.lit("x#InsertNoteID_1"))) == "#InsertNoteID_1"
