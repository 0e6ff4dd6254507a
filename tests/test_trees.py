"""Documents in expressions against documents on a parsed tree, and trees with implied ends."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import tree as T
from quire.functions.dom import markup, parse_html
from quire.operators import documents as D
from quire.operators import hooks
from quire.operators import trees as X
from quire.plans.containers import shaped
from quire.schemas import TABLES

PARTS = [
    "<p>", "</p>", "<b>", "</b>", "<td>", "<tr>", "<table border='0' summary='s&amp;x'>", "</table>", "<ul>", '<li id="InsertNoteID_1">', "</ul>", "text ", "a &amp; b &lt; &eacute; &#65; &#x42; &#0; &nope; &copy x ", "<br>", "<img src='http://x/y' alt=\"q\">",
    "<font color=red>", "</font>", "<a href='../c#r' name=n1>", "<a href=\"x?q\" onclick='y()' NAME=\"k\" id=z>", "</a>", '<span id="InsertNoteID_1_marker1" class="InsertNoteMarker"><sup><a href=\'#InsertNoteID_1\'>1</a></sup></span>', "<ol id='InsertNote_NoteList'>", "</ol>",
    "<h2> Head </h2>", "<h3></h3>", "<div epub:type='x' id='i1'>", "</div>", "<span epub:type='y' id=\"j\" aria-label='L'>", "</span>", "<b epub:type=z id=k/>", "<i epub:type='z' id='k'/>", "<!-- c <p> -->", "<script>if (a < b) { '</p>' }</script>", "<svg viewBox='0 0 1 1' width=1>", "</svg>",
    "<dl x=1><dt>a<dd>b</dl>", "<select><optgroup><option>1<option>2<optgroup><option>3</select>", "< 3 ", "<section>", "</section>", "\n", "<big>", "é漢", "<p class=a class=b>", "<thead><tr><th>1<tbody><tr><td>2", "<ruby>a<rt>b<rp>c</ruby>",
]
HEAD = "<head><meta charset='u'><title></title><link href='a' bad='x' rel=s><style>p > a{}</style></head>"


@pytest.fixture(scope="module")
def sources():
    rng, out = random.Random(7), []
    for i in range(300):
        body = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        out.append((body, f"<html lang='x'>{HEAD}<body class='b' onload='x'>{body}</body></html>", f"<!DOCTYPE html><html>{HEAD}<body>{body}", f"<body>{body}</body>", f"{HEAD}<body>{body}</body> tail")[i % 5])
    # More tokens than one step of the fold takes, deep nesting, and documents without parts.
    return [*out, "<p>x<b>y</b>" * 200, "<div>" * 300 + "x", "", "<html></html>", "<html><body></body></html>", "text only", "<head></head>x", "<html><head><title>t</title></head></html>"]


@pytest.fixture(scope="module")
def docs(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "i int, t string").repartition(8).cache()


@pytest.mark.parametrize(("own", "exact"), [
    (lambda: T.let(T.document(F.col("t")), lambda d: T.file(d)), lambda d: D.document(parse_html(d)).decode()),
    (lambda: T.let(T.document(F.col("t")), T.body), lambda d: D.body_content(d.encode()).decode()),
    (lambda: T.let(T.document(F.col("t")), T.pages), lambda d: [(a, b) for _, a, b in D.pages("f", d.encode())]),
    (lambda: X.clean(F.col("t")), lambda d: (D.clean(d.encode())[0].decode(), D.clean(d.encode())[1])),
    (lambda: X.rewrite_links(F.col("t")), lambda d: D.rewrite_links(d.encode()).decode()),
    (lambda: X.footnotes(F.col("t")), lambda d: D.footnotes(d.encode()).decode()),
], ids=["file", "body", "pages", "clean", "links", "footnotes"])
def test_expressions_do_what_trees_do(docs, sources, own, exact):
    got = {r.i: tuple(r.x) if isinstance(r.x, tuple) else [tuple(x) for x in r.x] if isinstance(r.x, list) else r.x for r in docs.select("i", own().alias("x")).collect()}
    assert [(d, got[i], exact(d)) for i, d in enumerate(sources) if got[i] != exact(d)] == []


def test_element_table(docs, sources):
    got = {}
    for r in T.elements(docs, ["i"], "t").collect():
        got.setdefault(r.i, {})[r.id] = r
    for i, d in enumerate(sources):
        root = parse_html(d)
        if "<html" not in d:
            continue
        want = [(e.name, [tuple(a) for a in e.attrs.items()], e.lead()) for e in root.walk()]
        own = [got[i][k] for k in sorted(got.get(i, {}))]
        own = own[next(k for k, r in enumerate(own) if r.name == "html") :]
        own = [r for r in own if r.id < own[0].end]
        assert [(r.name, [tuple(a) for a in {a.k: a.v for a in r.attrs}.items()], r.lead) for r in own] == want, d
        ups = root.parents()
        depth = {id(root): 0}
        for e in root.walk():
            depth[id(e)] = 0 if e is root else depth[id(ups[id(e)])] + 1
        assert [r.depth for r in own] == [depth[id(e)] for e in root.walk()]
        assert all(r.parent == 0 or got[i][r.parent].id < r.id < got[i][r.parent].end for r in own)


@pytest.mark.parametrize(("html", "want"), [
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"),
    ("<table><thead><tr><th>1<tbody><tr><td>2<tfoot><tr><td>3</table>", "<table><thead><tr><th>1</th></tr></thead><tbody><tr><td>2</td></tr></tbody><tfoot><tr><td>3</td></tr></tfoot></table>"),
    ("<table><tr><td>1<table><tr><td>2<tr><td>3</table><td>4</table>", "<table><tr><td>1<table><tr><td>2</td></tr><tr><td>3</td></tr></table></td><td>4</td></tr></table>"),
    ("<dl><dt>a<dd>b<dt>c<dd>d<dd>e</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dd>e</dd></dl>"),
    ("<select><optgroup><option>1<option>2<optgroup><option>3</select>", "<select><optgroup><option>1</option><option>2</option></optgroup><optgroup><option>3</option></optgroup></select>"),
    ("<ul><li>a<p>b<li>c<ul><li>d<li>e</ul><li>f</ul>", "<ul><li>a<p>b</p></li><li>c<ul><li>d</li><li>e</li></ul></li><li>f</li></ul>"),
    ("<p>a<p>b<div>c<p>d</div>", "<p>a</p><p>b</p><div>c<p>d</p></div>"),
])
def test_implied_ends_chain(spark, html, want):
    assert "".join(map(markup, parse_html(html).find("body").kids)) == want
    own = spark.createDataFrame([(html,)], "t string").select(T.let(T.document(F.col("t")), lambda d: T.markup(d, lambda i: T.in_body(d, i)))).first()[0]
    assert own == want


def test_items_in_expressions(spark):
    html = b"<html><head><title>old</title></head><body><p>a<font>b</font><a href='c'>d</a></p></body></html>"
    rows = spark.createDataFrame([(0, "html", html), (1, "image", b"\xff\xd8"), (2, "html", None), (3, "nav", b"\xff<p>x</p>")], "pos int, kind string, content binary")
    items = shaped(rows, TABLES["items"], book=F.lit("b"), pos=F.col("pos"), kind=F.col("kind"), content=F.col("content"), title=F.lit("T & t"), file_name=F.lit("f"), properties=F.array(F.lit("svg")))
    for own, change in ((X.clean_items, D.syntax_hook), (X.link_items, D.links_hook), (X.footnote_items, D.footnotes_hook), (lambda x: X.render(x, "en"), lambda r: {"content": D.render(r, "en")})):
        got, want = ({r.pos: (bytes(r.content or b""), r.properties) for r in df.collect()} for df in (own(items), D.map_documents(items, change)))
        assert got == want and got[1][0] == b"\xff\xd8"
        assert "MapInArrow" not in own(items)._jdf.queryExecution().toString() and own(items).columns == items.columns
    assert X.element_table(items).where("name = 'a'").select("book", "pos", "lead").collect() == [("b", 0, "d")]
    assert X.bodies(items).where("pos = 0").first().body == D.body_content(html)


def test_hooks_are_one_pass(spark):
    rows = spark.createDataFrame([(0, "html", b"<html><body><p><a href='c' name='n'>d</a><font>x</font></p></body></html>"), (1, "image", b"\xff"), (2, None, b"y")], "pos int, kind string, content binary")
    items = shaped(rows, TABLES["items"], book=F.lit("b"), pos=F.col("pos"), kind=F.col("kind"), content=F.col("content"))
    from quire.sources.reader import Corpus

    corpus = Corpus(**{t: items if t == "items" else spark.createDataFrame([], s) for t, s in TABLES.items()})

    class Custom:
        def html_before_write(self, x):
            return x.withColumn("title", F.lit("seen"))

    class Each:
        document_after_read = staticmethod(lambda row: {"title": "never"})
        document_before_write = staticmethod(lambda row: {"title": f"{row['title']}+{row['content'].count(b'.xhtml')}"})

    chain = [hooks.Syntax(), hooks.DocumentLinks(), hooks.Footnotes(), hooks.SourceHighlight()]
    for k in range(1, 5):
        plan = hooks.before_write(corpus, chain[:k]).items._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Union") == 0, plan
    plan = hooks.before_write(corpus, [*chain, Custom(), Each()]).items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("LogicalRDD") == 1
    got = {r.pos: r for r in hooks.before_write(corpus, [*chain, Custom(), Each()]).items.collect()}
    assert got[0].title == "seen+1" and got[1].title == got[2].title == "seen" and bytes(got[1].content) == b"\xff" and bytes(got[2].content) == b"y"
    assert b"c.xhtml" in got[0].content and b"font" not in got[0].content
