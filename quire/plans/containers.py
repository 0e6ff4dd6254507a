"""Queries through the container format: tables are written as books, read back, and must be what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..operators import documents as D
from ..operators import hooks
from ..schemas import TABLES
from ..sources.reader import Corpus, read_corpus
from ..sources.writer import write_corpus
from ..workdir import new_path
from .queries import _H1, ORACLES, QUERIES
from .tables import PAGES_SQL, pages, read


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def shaped(df: DataFrame, schema: str, **columns) -> DataFrame:
    """``df`` as a corpus table: the columns given, nulls (empty lists) for others."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def corpus_of_pages(spark: SparkSession, sf_dir: str) -> Corpus:
    """Books of fifty pages of a language at most; each fifth of them is a section."""
    p = pages(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(".xhtml")))
    b, n = F.col("book"), F.col("pos")
    title = F.coalesce(H.heading("html"), F.lit("untitled"))
    books = p.select("book").distinct()
    items = shaped(p, TABLES["items"], book=b, pos=n, kind=F.lit("html"), id=F.concat(F.lit("i"), n.cast("string")), file_name=F.col("name"), media_type=F.lit(C.XHTML_TYPE), is_linear=F.lit(True), manifest=F.lit(True), title=title, properties=F.array(F.when(n % 4 == 0, "scripted").otherwise("svg")), content=F.encode("html", "UTF-8"))
    nav = shaped(books, TABLES["items"], book=b, pos=F.lit(-1), kind=F.lit("nav"), id=F.lit("nav"), file_name=F.lit("nav/toc.xhtml"), media_type=F.lit(C.XHTML_TYPE), is_linear=F.lit(True), manifest=F.lit(True))
    leaf = F.array((n % 5).cast("int"), n.cast("int"))
    toc = shaped(p, TABLES["toc"], book=b, path=leaf, parent_path=F.array((n % 5).cast("int")), depth=F.lit(2), node_kind=F.lit("link"), title=title, href=F.col("name"), uid=F.concat(F.lit("i"), n.cast("string")))
    tops = p.select("book", (n % 5).cast("int").alias("k")).distinct()
    toc = toc.unionByName(shaped(tops, TABLES["toc"], book=b, path=F.array("k"), parent_path=F.array().cast("array<int>"), depth=F.lit(1), node_kind=F.lit("section"), title=F.concat(F.lit("Part "), F.col("k").cast("string")), href=F.lit("")))
    attrs = lambda *kv: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in kv])
    entry = lambda seq, name, value, a: shaped(books, TABLES["metadata"], book=b, seq=F.lit(seq), ns=F.lit(C.NAMESPACES["DC"]), name=F.lit(name), value=value, attrs=a)
    metadata = entry(0, "identifier", F.concat(F.lit("urn:"), b), attrs(("id", "uid"))).unionByName(entry(1, "title", F.concat(F.lit("Pages & <"), b, F.lit(">")), attrs())).unionByName(entry(2, "language", b, attrs()))
    return Corpus(
        books=shaped(books, TABLES["books"], book=b, version=F.lit("3.0"), identifier_id=F.lit("uid"), uid=F.concat(F.lit("urn:"), b), title=F.concat(F.lit("Pages & <"), b, F.lit(">")), language=b, direction=F.lit("ltr"), folder=F.lit("EPUB")),
        metadata=metadata, items=items.unionByName(nav), toc=toc,
        spine=shaped(p, TABLES["spine"], book=b, pos=n, idref=F.concat(F.lit("i"), n.cast("string")), linear=F.when(n % 7 == 0, "no").otherwise("yes")),
        guide=shaped(p, TABLES["guide"], book=b, pos=n, href=F.col("name"), title=title, type=F.lit("text")),
        page_list=spark.createDataFrame([], TABLES["page_list"]), bindings=spark.createDataFrame([], TABLES["bindings"]),
    )


def round_trip(spark: SparkSession, sf_dir: str, **options) -> Corpus:
    path = new_path(spark, "books")
    write_corpus(corpus_of_pages(spark, sf_dir), path, {"mtime": "2024-01-01T00:00:00+00:00", "render": False, **options})
    return read_corpus(spark, path)


def _book() -> F.Column:
    return F.regexp_extract("book", r"([^/]+)\.epub$", 1).alias("book")


@query(f"""SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS pos, 'i' || pos AS id, 'html' AS kind, 'p' || pos || '.xhtml' AS file_name, md5(html) AS digest, CASE WHEN pos % 4 = 0 THEN 'scripted' ELSE 'svg' END AS properties FROM {PAGES_SQL}""")
def container_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, byte for byte, through containers."""
    i = round_trip(spark, sf_dir).items.where("kind <> 'nav'")
    return i.select(_book(), F.col("pos").cast("long").alias("pos"), "id", "kind", "file_name", F.md5("content").alias("digest"), F.array_join("properties", " ").alias("properties"))


@query(f"""WITH p AS (SELECT book, pos, pos % 5 AS k, coalesce({_H1}, 'untitled') AS title FROM {PAGES_SQL}),
t AS (SELECT book, k, -1 AS pos, 'section' AS node_kind, 'Part ' || k AS title, '' AS href FROM (SELECT DISTINCT book, k FROM p) UNION ALL SELECT book, k, pos, 'link', title, 'p' || pos || '.xhtml' FROM p)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY k, pos) AS n, node_kind, trim(title) AS title, href FROM t""")
def container_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation tree, in pre-order, through the navigation document."""
    from pyspark.sql import Window

    t = round_trip(spark, sf_dir).toc
    n = F.row_number().over(Window.partitionBy("book").orderBy("path"))
    return t.withColumn("n", n.cast("long")).select(_book(), "n", "node_kind", F.trim("title").alias("title"), F.regexp_replace("href", "^nav/", "").alias("href"))


@query(f"""SELECT book, 0 AS k, 'title' AS name, 'Pages & <' || book || '>' AS value FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 1, 'uid', 'urn:' || book FROM {PAGES_SQL} GROUP BY 1
UNION ALL SELECT book, 2, 'language', book FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 3, 'direction', 'ltr' FROM {PAGES_SQL} GROUP BY 1""")
def container_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = round_trip(spark, sf_dir).books
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.col(n).alias("value")) for k, n in enumerate(("title", "uid", "language", "direction"))])
    return b.select(_book(), F.inline(pairs))


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, 'i' || pos AS idref, CASE WHEN pos % 7 = 0 THEN 'no' ELSE 'yes' END AS linear FROM {PAGES_SQL}")
def container_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir).spine.select(_book(), F.col("pos").cast("long").alias("pos"), "idref", "linear")


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, 'p' || pos || '.xhtml' AS href, 'text' AS type FROM {PAGES_SQL} ")
def container_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir).guide.select(_book(), F.col("pos").cast("long").alias("pos"), "href", "type")


def _turns(spark: SparkSession, sf_dir: str, content: F.Column) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    at = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return shaped(c, TABLES["items"], book=F.col("conv_id").cast("string"), pos=F.col("turn"), kind=F.lit("html"), id=at, file_name=F.concat(at, F.lit(".xhtml")), properties=F.array().cast("array<string>"), content=F.encode(content, "UTF-8"))


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS pos, CASE turn % 4 WHEN 0 THEN '../c' || turn || '/.xhtml#r' WHEN 1 THEN 'c' || turn || '.xhtml' WHEN 2 THEN 'http://x/c' || turn ELSE '#InsertNoteID_' || turn END AS href,
CASE WHEN turn % 4 < 2 THEN 'n' || turn END AS id FROM conversations""")
def exact_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of whole documents rewritten on the tree."""
    t = F.col("turn").cast("string")
    href = F.element_at(F.array(F.concat(F.lit("../c"), t, F.lit("/#r")), F.concat(F.lit("c"), t, F.lit("?q=1")), F.concat(F.lit("http://x/c"), t), F.concat(F.lit("z#InsertNoteID_"), t)), (F.col("turn") % 4 + 1).cast("int"))
    done = hooks.DocumentLinks().html_before_write(_turns(spark, sf_dir, F.concat(F.lit("<html><body><p>t<a name='n"), t, F.lit("' href='"), href, F.lit("'>x</a></p></body></html>"))))
    tag = F.regexp_extract(F.decode("content", "UTF-8"), "(<a [^>]*>)", 1)
    return done.select("book", "pos", H.attribute(tag, "href").alias("href"), F.nullif(H.attribute(tag, "id"), F.lit("")).alias("id"))


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS pos, 'Note ' || turn AS note, 'InsertNoteID_' || turn AS id, 0::INT AS lists FROM conversations""")
def exact_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked notes as asides."""
    t = F.col("turn").cast("string")
    uid = F.concat(F.lit("InsertNoteID_"), t)
    html = F.concat(F.lit('<html><body><p>a<span id="'), uid, F.lit('_marker1" class="InsertNoteMarker"><sup><a href="#'), uid, F.lit('">1</a></sup></span></p><ol id="InsertNote_NoteList"><li id="'), uid, F.lit('">Note '), t, F.lit("<span>back</span></li></ol></body></html>"))
    done = hooks.Footnotes().html_before_write(_turns(spark, sf_dir, html)).withColumn("c", F.decode("content", "UTF-8"))
    return done.select("book", "pos", F.regexp_extract("c", "<aside[^>]*><p>([^<]*)</p></aside>", 1).alias("note"), F.regexp_extract("c", '<aside id="([^"]*)" epub:type="footnote">', 1).alias("id"), F.regexp_count("c", F.lit("NoteList")).alias("lists"))


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS pos, '<p class="k">' || CASE turn % 3 WHEN 0 THEN 'old text' WHEN 1 THEN '<a href="h">l</a>' ELSE '<img alt="a" src="http://x/i.png"/>' END || '</p>' AS body, CASE WHEN turn % 3 = 2 THEN 'remote-resources' ELSE '' END AS properties FROM conversations""")
def exact_syntax_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deprecated tags and unknown attributes removed on the tree."""
    inner = F.element_at(F.array(F.lit("<font size='1'>old <strike>text</strike></font>"), F.lit("<a href='h' onclick='x()' rev='r'>l</a>"), F.lit("<img alt='a' src='http://x/i.png' border='0'>")), (F.col("turn") % 3 + 1).cast("int"))
    done = hooks.Syntax().html_before_write(_turns(spark, sf_dir, F.concat(F.lit("<html><head><meta name='x'/></head><body><p class='k' bgcolor='red'>"), inner, F.lit("</p></body></html>"))))
    return done.select("book", "pos", F.regexp_extract(F.decode("content", "UTF-8"), "<body>(.*)</body>", 1).alias("body"), F.array_join("properties", " ").alias("properties"))


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS doc_pos, n::INT AS n, 'k' || n AS fragment, CASE n WHEN 0 THEN coalesce(nullif(trim(text, chr(9) || chr(10) || chr(13) || ' '), ''), 'k0') WHEN 1 THEN 'aria' WHEN 2 THEN 'Head ' || turn ELSE 'k3' END AS label
FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS n)""")
def exact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page marks with every kind of label: a turn's own text, an attribute, a heading, the id."""
    text = H.escape(F.coalesce("text", F.lit("")))
    html = F.concat(F.lit('<body><div><span epub:type="pagebreak" id="k0"> '), text, F.lit(' </span><i epub:type="pagebreak" id="k1" aria-label="aria"/><section epub:type="x" id="k2"><h3>Head '), F.col("turn").cast("string"), F.lit('</h3></section><b epub:type="y" id="k3"/><b epub:type="z"/></div></body>'))
    return D.pages_of(_turns(spark, sf_dir, html)).select("book", "doc_pos", "n", "fragment", "label")


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS pos, 'T' || turn AS title, CASE WHEN turn % 2 = 0 THEN 'fr' ELSE 'en' END AS lang, 'style.css' AS link, '<p>x</p>' AS body FROM conversations""")
def exact_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents rendered from their parts; the source's own head is dropped."""
    i = _turns(spark, sf_dir, F.lit("<html><head><title>source</title></head><body><p>x</p></body></html>"))
    link = F.array(F.create_map(F.lit("href"), F.lit("style.css"), F.lit("rel"), F.lit("stylesheet")))
    i = i.withColumns({"title": F.concat(F.lit("T"), F.col("pos").cast("string")), "lang": F.when(F.col("pos") % 2 == 0, "fr").otherwise(""), "links": link})
    done = D.map_documents(i, lambda r: {"content": D.render(r | {"links": [dict(x) for x in r["links"]]}, "en")}).withColumn("c", F.decode("content", "UTF-8"))
    return done.select("book", "pos", F.regexp_extract("c", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("c", ' xml:lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("c", '<link href="([^"]*)"', 1).alias("link"), F.regexp_extract("c", "<body>(.*)</body>", 1).alias("body"))


@query("""SELECT conv_id::VARCHAR AS book, turn::INT AS pos, turn % 2 = 0 AS highlighted, CASE WHEN turn % 2 = 0 THEN 'style/code.css' END AS link FROM conversations""")
def exact_source_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded sources highlighted, with the link to their style; other languages stay."""
    html = F.when(F.col("turn") % 2 == 0, "<body><pre class='source-python'>def f(x): return x</pre></body>").otherwise("<body><pre class='source-cobol'>STOP RUN</pre></body>")
    done = hooks.SourceHighlight().html_before_write(_turns(spark, sf_dir, html))
    return done.select("book", "pos", F.contains(F.decode("content", "UTF-8"), F.lit('<div class="highlight">')).alias("highlighted"), F.get("links", F.lit(0))["href"].alias("link"))
