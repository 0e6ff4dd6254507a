"""More queries through containers and over items: navigation files, page lists, bindings, folders, broken packages, templates, hooks, setters and errors.

The SQL says what the container format and the reference ask for; it is written from their text, not from the operators.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..functions import items as I
from ..operators import catalogue as K
from ..operators import documents as D
from ..operators import hooks
from ..operators import navigation as N
from ..schemas import TABLES
from ..sources.reader import Corpus, parse_containers, parse_once, read_corpus, register
from ..sources.writer import pack, unpack, write_corpus
from ..workdir import new_path
from .containers import _book, corpus_of_pages, query, shaped
from .queries import _H1, ITEMS_SQL
from .tables import PAGES_SQL, TREE_SQL, items, pages, read, tree

MTIME = "2024-01-01T00:00:00+00:00"
_ATTRS = lambda *kv: F.array(*[F.struct(F.lit(k).alias("k"), (v if isinstance(v, F.Column) else F.lit(v)).alias("v")) for k, v in kv])


def _written(spark: SparkSession, corpus: Corpus, ignore_ncx: bool = True, **options) -> Corpus:
    path = new_path(spark, "books")
    write_corpus(corpus, path, {"mtime": MTIME, "render": False, **options})
    return read_corpus(spark, path, ignore_ncx=ignore_ncx)


def _with_ncx(corpus: Corpus) -> Corpus:
    """The corpus with an older navigation file in each book instead of the newer one."""
    own = corpus.books.select("book")
    ncx = shaped(own, TABLES["items"], book=F.col("book"), pos=F.lit(-1), kind=F.lit("ncx"), id=F.lit("ncx"), file_name=F.lit("toc.ncx"), media_type=F.lit(C.NCX_TYPE), is_linear=F.lit(True), manifest=F.lit(True))
    return replace(corpus, items=corpus.items.where("kind <> 'nav'").unionByName(ncx))


_TREE = f"""p AS (SELECT book, pos, pos % 5 AS k, coalesce({_H1}, 'untitled') AS title, 'p' || pos || '.xhtml' AS href FROM {PAGES_SQL}),
t AS (SELECT book, k, -1 AS pos, 'section' AS node_kind, 'Part ' || k AS title, arg_min(href, pos) AS href, NULL AS uid FROM p GROUP BY book, k UNION ALL SELECT book, k, pos, 'link', title, href, 'i' || pos FROM p)"""


@query(f"WITH {_TREE} SELECT book, row_number() OVER (PARTITION BY book ORDER BY k, pos) AS n, node_kind, trim(title) AS title, href, uid FROM t")
def container_ncx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation tree through the older file: ids stay, a section without a link has that of the first leaf right below it."""
    t = _written(spark, _with_ncx(corpus_of_pages(spark, sf_dir)), ignore_ncx=False).toc
    n = F.row_number().over(W.partitionBy("book").orderBy("path"))
    return t.withColumn("n", n.cast("long")).select(_book(), "n", "node_kind", F.trim("title").alias("title"), "href", "uid")


@query(f"""WITH {_TREE}, s AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY k, pos) + 4 AS play, row_number() OVER (PARTITION BY book, node_kind ORDER BY k, pos) - 1 AS m FROM t)
SELECT book, play, CASE node_kind WHEN 'section' THEN 'sep_' || m ELSE uid END AS nav_id, href AS src FROM s""")
def container_play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, play order from 5 on and links of the older navigation file, as its text has them."""
    got = _written(spark, _with_ncx(corpus_of_pages(spark, sf_dir)), play_order=True, play_order_start=5).items.where("kind = 'ncx'")
    points = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r'(?s)(<navPoint id="[^"]*" playOrder="\d+">.*?<content src="[^"]*"/>)'), F.lit(1))
    own = got.select(_book(), F.explode(points).alias("p"))
    return own.select("book", F.regexp_extract("p", r'playOrder="(\d+)"', 1).cast("long").alias("play"), H.attribute(F.col("p"), "id").alias("nav_id"), F.regexp_extract("p", '<content src="([^"]*)"', 1).alias("src"))


def _marked(corpus: Corpus) -> Corpus:
    mark = F.concat(F.lit('<span epub:type="pagebreak" id="pg'), F.col("pos").cast("string"), F.lit('">'), (F.col("pos") * 2).cast("string"), F.lit("</span></body>"))
    return replace(corpus, items=corpus.items.withColumn("content", F.when(F.col("kind") == "html", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("</body>"), mark), "UTF-8")).otherwise(F.col("content"))))


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS n, 'nav/p' || pos || '.xhtml' AS entry, 'p' || pos || '.xhtml' AS file_name, 'pg' || pos AS fragment, (pos * 2)::VARCHAR AS label FROM {PAGES_SQL} WHERE html LIKE '%</body>%'")
def container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page marks of documents, through the page list of the navigation document."""
    got = _written(spark, _marked(corpus_of_pages(spark, sf_dir))).page_list
    own = F.regexp_replace("file_name", "^nav/", "")
    return got.select(_book(), F.col("pos").cast("long").alias("n"), F.concat(F.lit("nav/"), own).alias("entry"), own.alias("file_name"), "fragment", "label")


@query(f"SELECT book, k::INT AS pos, CASE k WHEN 0 THEN 'application/x-demo-' || book ELSE 'x/' || k END AS media_type, 'handler' || k AS handler FROM (SELECT DISTINCT book FROM {PAGES_SQL}), (SELECT unnest([0, 1, 2]) AS k)")
def container_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of media types to handlers, through the package."""
    c = corpus_of_pages(spark, sf_dir)
    rows = c.books.select("book", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    media = F.when(F.col("k") == 0, F.concat(F.lit("application/x-demo-"), "book")).otherwise(F.concat(F.lit("x/"), F.col("k").cast("string")))
    own = shaped(rows, TABLES["bindings"], book=F.col("book"), pos=F.col("k"), attrs=F.create_map(F.lit("media-type"), media, F.lit("handler"), F.concat(F.lit("handler"), F.col("k").cast("string"))))
    got = _written(spark, replace(c, bindings=own)).bindings
    return got.select(_book(), "pos", F.col("attrs")["media-type"].alias("media_type"), F.col("attrs")["handler"].alias("handler"))


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, 'i' || pos AS idref, CASE WHEN pos % 7 = 0 THEN 'no' ELSE 'yes' END AS linear FROM {PAGES_SQL}")
def folder_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of books that are unpacked folders."""
    path = new_path(spark, "folders")
    unpack(pack(corpus_of_pages(spark, sf_dir), {"mtime": MTIME, "render": False}), path)
    register(spark)
    got = spark.read.format("epub").option("table", "spine").load(path)
    return got.select(F.regexp_extract("book", "([^/]+)/?$", 1).alias("book"), F.col("pos").cast("long").alias("pos"), "idref", "linear")


def _broken(packed: DataFrame) -> DataFrame:
    """Containers whose package has a stray end, a bare mark, an unquoted attribute and no end of its spine."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(1):
                made = io.BytesIO()
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z, zipfile.ZipFile(made, "w") as to:
                    for e in z.infolist():
                        raw = z.read(e)
                        if e.filename.endswith(".opf"):
                            raw = raw.replace(b"</metadata>", b"</stray>a & b < c</metadata>").replace(b"</spine>", b"").replace(b"<manifest>", b"<manifest loose=1>")
                        to.writestr(e, raw)
                out.append(made.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["book", "content"])

    return packed.select("book", "data").mapInArrow(run, "book string, content binary")


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS pos, 'i' || pos AS id, 'p' || pos || '.xhtml' AS file_name, md5(html) AS digest FROM {PAGES_SQL}")
def container_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of books whose package is broken XML."""
    files = _broken(pack(corpus_of_pages(spark, sf_dir), {"mtime": MTIME, "render": False}))
    got = parse_containers(files, "items").where("kind = 'html'")
    return got.select("book", F.col("pos").cast("long").alias("pos"), "id", "file_name", F.md5("content").alias("digest"))


@query(f"SELECT book, count(*)::BIGINT AS n_spine, NULL::VARCHAR AS direction, 0::BIGINT AS n_guide, 0::BIGINT AS n_pages, 0::BIGINT AS landmarks FROM {PAGES_SQL} GROUP BY 1")
def container_options_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guide, landmarks, page list and direction left out by options."""
    c = _marked(corpus_of_pages(spark, sf_dir))
    got = _written(spark, c, epub2_guide=False, epub3_landmark=False, epub3_pages=False, spine_direction=False)
    count = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    marks = got.items.where("kind = 'nav'").select("book", F.regexp_count(F.decode("content", "UTF-8"), F.lit('epub:type="landmarks"')).cast("long").alias("landmarks"))
    out = got.books.join(count(got.spine, "n_spine"), "book").join(count(got.guide, "n_guide"), "book", "left").join(count(got.page_list, "n_pages"), "book", "left").join(marks, "book")
    return out.select(_book(), "n_spine", "direction", F.coalesce("n_guide", F.lit(0)).cast("long").alias("n_guide"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"), "landmarks")


@query(f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS n, 'bodymatter' AS type, '../p' || pos || '.xhtml' AS href, 'Where' AS heading FROM {PAGES_SQL}")
def container_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks in the navigation document, under their names there and relative to it."""
    nav = F.decode("content", "UTF-8")
    got = _written(spark, corpus_of_pages(spark, sf_dir), landmark_title="Where").items.where("kind = 'nav'").select(_book(), F.regexp_extract(nav, '(?s)<nav epub:type="landmarks">(.*?)</nav>', 1).alias("land"))
    links = F.regexp_extract_all("land", F.lit("(<a [^>]*>)"), F.lit(1))
    own = got.select("book", F.regexp_extract("land", "<h2>([^<]*)</h2>", 1).alias("heading"), F.posexplode(links).alias("n", "a"))
    return own.select("book", F.col("n").cast("long").alias("n"), H.attribute(F.col("a"), "epub:type").alias("type"), H.href(F.col("a")).alias("href"), "heading")


@query(f"""SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS pos, coalesce({_H1}, 'untitled') AS title, CASE WHEN pos % 3 = 0 THEN 'xx' ELSE book END AS lang,
CASE WHEN pos % 4 = 1 THEN 'rtl' END AS dir, 's' || pos || '.css' AS style, 'mine' AS template, CASE WHEN pos % 2 = 0 THEN 'note ' || pos END AS meta FROM {PAGES_SQL}""")
def container_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered into a book's own template, with their titles, languages, directions, links and metas, through containers."""
    c = corpus_of_pages(spark, sf_dir)
    doc = F.col("kind") == "html"
    books = K.set_template(c.books, "chapter", b'<?xml version="1.0"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" data-template="mine"></html>')
    own = K.set_language(c.items, doc & (F.col("pos") % 3 == 0), "xx")
    own = K.set_direction(own, doc & (F.col("pos") % 4 == 1), "rtl")
    at = F.col("pos").cast("string")
    own = own.withColumns({
        "links": F.when(doc, F.array(F.create_map(F.lit("href"), F.concat(F.lit("s"), at, F.lit(".css")), F.lit("rel"), F.lit("stylesheet")))),
        "metas": F.when(doc & (F.col("pos") % 2 == 0), F.array(F.create_map(F.lit("name"), F.lit("note"), F.lit("content"), F.concat(F.lit("note "), at)))),
    })
    got = _written(spark, replace(c, books=books, items=own), render=True).items.where("kind = 'html'").withColumn("c", F.decode("content", "UTF-8"))
    head, root = F.regexp_extract("c", "(?s)<head>(.*?)</head>", 1), F.regexp_extract("c", "(<html[^>]*>)", 1)
    none = lambda c: F.nullif(c, F.lit(""))
    title = F.regexp_extract(head, "<title>([^<]*)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(a), F.lit(b))
    return got.select(_book(), F.col("pos").cast("long").alias("pos"), title.alias("title"), H.attribute(root, "lang").alias("lang"), none(H.attribute(root, "dir")).alias("dir"), F.regexp_extract(head, '<link href="([^"]*)"', 1).alias("style"), H.attribute(root, "data-template").alias("template"), none(F.regexp_extract(head, 'content="(note [^"]*)"', 1)).alias("meta"))


@query(f"""SELECT book, 0 AS k, 'identifier' AS name, 'urn:new:' || book AS value FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 1, 'title', 'Pages & <' || book || '>' FROM {PAGES_SQL} GROUP BY 1
UNION ALL SELECT book, 2, 'title', 'Second of ' || book FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 3, 'language', book FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 4, 'language', 'la' FROM {PAGES_SQL} GROUP BY 1
UNION ALL SELECT book, 5, 'generator', 'by-' || book FROM {PAGES_SQL} GROUP BY 1 UNION ALL SELECT book, 6, 'modified', '2024-01-01T00:00:00Z' FROM {PAGES_SQL} GROUP BY 1""")
def container_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identifier after it is set again, two titles and languages, the generator, and one time of modification in place of an old one."""
    c = corpus_of_pages(spark, sf_dir)
    b = F.col("book")
    meta = K.set_identifiers(c.metadata, c.books.select("book", F.concat(F.lit("urn:new:"), b).alias("uid")), "uid")
    meta = K.add_titles(meta, c.books.select("book", F.concat(F.lit("Second of "), b).alias("value")))
    meta = K.add_titles(meta, c.books.select("book", F.lit("la").alias("value")), "language")
    opf = lambda value, attrs: c.books.select("book", F.lit(0).alias("seq"), F.lit("OPF").alias("ns"), F.lit("meta").alias("name"), F.lit(value).alias("value"), attrs.alias("attrs"))
    meta = K.add_metadata(meta, opf("", _ATTRS(("name", "generator"), ("content", F.concat(F.lit("by-"), b)))))
    meta = K.add_metadata(meta, opf("1999-01-01T00:00:00Z", _ATTRS(("property", "dcterms:modified"))))
    got = _written(spark, replace(c, metadata=meta)).metadata
    a = lambda k: F.get(F.filter("attrs", lambda x: x["k"] == k), F.lit(0))["v"]
    name = F.when(a("name") == "generator", "generator").when(a("property") == "dcterms:modified", "modified").otherwise(F.col("name"))
    own = got.select(_book(), "seq", name.alias("name"), F.when(name == "generator", a("content")).otherwise(F.col("value")).alias("value"))
    rank = I.choose(F.col("name"), {"identifier": 0, "title": 1, "language": 3, "generator": 5, "modified": 6})
    nth = F.row_number().over(W.partitionBy("book", "name").orderBy("seq")) - 1
    return own.select("book", (rank + nth).cast("int").alias("k"), "name", "value")


@query(f"SELECT book, 'rendition: http://www.idpf.org/vocab/rendition/# mine: http://example.org/' || book || ' other: http://example.org/o' AS prefix FROM {PAGES_SQL} GROUP BY 1")
def container_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes added to books, in the package's text."""
    c = corpus_of_pages(spark, sf_dir)
    books = c.books.withColumn("prefixes", F.array(I.prefix(F.lit("mine"), F.concat(F.lit("http://example.org/"), "book"))))
    packed = pack(replace(c, books=K.add_prefix(books, "other", "http://example.org/o")), {"mtime": MTIME, "render": False})

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(1):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    out.append(z.read("EPUB/content.opf").decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["book", "opf"])

    return packed.mapInArrow(run, "book string, opf string").select("book", F.regexp_extract("opf", '<package[^>]* prefix="([^"]*)"', 1).alias("prefix"))


@query(f"SELECT CASE k WHEN 0 THEN book ELSE book || '-' || ['', 'zip', 'opf', 'file'][k + 1] END AS book, ['', 'Bad Zip file', 'Can not find container file', 'Can not find gone.xhtml'][k + 1] AS error, [NULL, 0, -1, -1][k + 1]::INT AS error_code FROM (SELECT DISTINCT book FROM {PAGES_SQL}), (SELECT unnest([0, 1, 2, 3]) AS k)")
def container_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with books that can't be read, as rows beside those of good ones."""
    good = pack(corpus_of_pages(spark, sf_dir), {"mtime": MTIME, "render": False})

    def run(batches):
        for batch in batches:
            names, out = [], []
            for book, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(4):
                    made = io.BytesIO()
                    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(made, "w") as to:
                        for e in z.infolist():
                            raw = z.read(e)
                            if e.filename.endswith(".opf") and k == 2:
                                continue
                            to.writestr(e, raw.replace(b"<manifest>", b'<manifest><item href="gone.xhtml" id="gone" media-type="application/xhtml+xml"/>') if e.filename.endswith(".opf") and k == 3 else raw)
                    names.append(book + ("", "-zip", "-opf", "-file")[k])
                    out.append(b"no archive" if k == 1 else made.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], names=["book", "content"])

    return parse_once(good.mapInArrow(run, "book string, content binary")).books.select("book", F.coalesce("error", F.lit("")).alias("error"), "error_code")


class _Seen:
    """A hook of every kind."""

    def after_read(self, corpus: Corpus) -> Corpus:
        return replace(corpus, books=corpus.books.withColumn("title", F.concat("title", F.lit("+read"))))

    def html_after_read(self, items: DataFrame) -> DataFrame:
        return D.map_documents(items, lambda r: {"title": f"{r['id']}+read"})

    def before_write(self, corpus: Corpus) -> Corpus:
        return replace(corpus, books=corpus.books.withColumn("title", F.concat("title", F.lit("+write"))))

    def html_before_write(self, items: DataFrame) -> DataFrame:
        return D.map_documents(items, lambda r: {"title": f"{r['title']}+write"})

    def before_read(self, corpus: Corpus) -> Corpus:
        raise AssertionError("hooks of this name are never called")


@query(f"SELECT book, CASE WHEN id = 'nav' THEN 'nav' ELSE 'html' END AS kind, id, 'Pages & <' || book || '>+read+write' AS book_title, id || '+read+write' AS title FROM (SELECT book, 'i' || pos AS id FROM {PAGES_SQL} UNION ALL SELECT DISTINCT book, 'nav' FROM {PAGES_SQL})")
def hook_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks after reading and before writing, on books and on each document; others are never called, tidy too."""
    c = hooks.before_write(hooks.after_read(corpus_of_pages(spark, sf_dir), [_Seen(), hooks.Tidy()]), [_Seen()])
    return c.items.join(c.books.select("book", F.col("title").alias("book_title")), "book").select("book", "kind", "id", "book_title", "title")


@query(f"SELECT book, pos, kind IN ('html') AS is_chapter, CASE WHEN kind = 'html' THEN 'set' ELSE '' END AS content, CASE WHEN manifest THEN 'T' ELSE title END AS title, CASE WHEN kind = 'html' AND pos % 2 = 0 THEN 'rtl' END AS direction FROM {ITEMS_SQL}")
def item_setters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, title and direction set on some items, and which items are chapters."""
    own = items(spark, sf_dir).withColumns({"content": F.lit(None).cast("binary"), "direction": F.lit(None).cast("string")})
    own = K.set_content(own, F.col("kind") == "html", b"set")
    own = K.set_direction(K.set_value(own, F.col("manifest"), "title", "T"), (F.col("kind") == "html") & (F.col("pos") % 2 == 0), "rtl")
    return own.select("book", "pos", I.is_chapter("kind").alias("is_chapter"), F.decode(I.content("content"), "UTF-8").alias("content"), "title", "direction")


@query("""SELECT conv_id::VARCHAR AS book, turn AS pos, CASE WHEN turn % 2 = 0 THEN 'a.css,b.js' ELSE 'a.css' END AS links, CASE WHEN turn % 2 = 0 THEN 'svg scripted' ELSE 'svg' END AS properties, CASE WHEN turn % 3 = 0 THEN 'viewport=w' || ';' || 'x=' || role ELSE 'x=' || role END AS metas FROM conversations""")
def link_and_meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and metas added to documents; a script makes them scripted, once."""
    c = read(spark, sf_dir, "conversations")
    own = c.select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("pos"), F.array(F.lit("svg")).alias("properties"), F.lit(None).cast("array<map<string,string>>").alias("links"), F.array(F.create_map(F.lit("name"), F.lit("x"), F.lit("content"), F.col("role"))).alias("metas"))
    own = K.add_link(own, F.lit(True), {"href": "a.css", "rel": "stylesheet", "type": "text/css"})
    own = K.add_link(own, F.col("pos") % 2 == 0, {"href": "b.js", "type": "text/javascript"})
    own = K.add_meta(own, F.col("pos") % 3 == 0, {"name": "viewport", "content": "w"})
    meta = K.metas(own).groupBy("book", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("meta")["name"], F.lit("="), F.col("meta")["content"]))), ";").alias("metas"))
    return own.select("book", "pos", F.array_join(F.transform("links", lambda x: x["href"]), ",").alias("links"), F.array_join("properties", " ").alias("properties")).join(meta, ["book", "pos"])


@query(f"""SELECT book, 'cover.xhtml' AS file_name, '<img src="' || book || '.jpg" alt="Cover" style="height:100%; text-align:center"/>' AS body, 'Cover' AS title, '{C.XHTML_TYPE}' AS media_type, 'name=cover;content=cover-img' AS meta FROM (SELECT DISTINCT book FROM {PAGES_SQL})""")
def container_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover image, its page and the entry that names it, through containers."""
    c = corpus_of_pages(spark, sf_dir)
    own, meta = K.set_cover(c.items, c.metadata, c.books.select("book", F.concat("book", F.lit(".jpg")).alias("file_name"), F.lit(b"img").alias("content")))
    got = _written(spark, replace(c, items=own, metadata=meta), render=True)
    page = got.items.where("file_name = 'cover.xhtml'").withColumn("c", F.decode("content", "UTF-8"))
    entry = got.metadata.where("name = 'meta'").withColumn("meta", F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ";")).where("meta LIKE '%cover-img%'").select("book", "meta")
    out = page.select("book", "file_name", F.regexp_extract("c", "<body>(.*)</body>", 1).alias("body"), F.regexp_extract("c", "<title>([^<]*)</title>", 1).alias("title"), "media_type").join(entry, "book")
    return out.select(_book(), "file_name", "body", "title", "media_type", "meta")


@query("""SELECT p.page_id, c.n::BIGINT AS depth, CASE c.n WHEN 1 THEN '' ELSE 'p' || (c.n - 1) END AS parent FROM pages p, (SELECT unnest(range(1, 101)) AS n) c""")
def toc_deep_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees a hundred levels deep."""
    p = pages(spark, sf_dir).select(F.col("pos").cast("string").alias("book"), F.explode(F.sequence(F.lit(1), F.lit(100))).alias("n"))
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    nodes = p.select("book", name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), F.lit(0).alias("ord"))
    out = N.walk(nodes).join(nodes.select("book", "id", "parent"), ["book", "id"])
    return out.select(F.col("book").cast("long").alias("page_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("parent", F.lit("")).alias("parent"))


@query("""SELECT book, uid, (row_number() OVER (PARTITION BY book ORDER BY path))::BIGINT AS number, depth FROM """ + TREE_SQL)
def toc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-order numbers and depths of trees given by parents, without paths."""
    t = tree(spark, sf_dir)
    nodes = t.select("book", F.col("uid").alias("id"), F.when(F.size("parent_path") > 0, F.concat(F.lit("n"), F.element_at("parent_path", -1).cast("string"))).alias("parent"), F.element_at("path", -1).alias("ord"))
    return N.preorder(nodes).select("book", F.col("id").alias("uid"), "number", "depth")


@query(f"""WITH t AS (SELECT book, pos, CASE k WHEN 0 THEN '<li><a href="p' || pos || '.xhtml">&lt;' || pos || '&gt;</a><ol>' WHEN 1 THEN '<li><span>b</span><ol>' WHEN 2 THEN '<li><a href="c&amp;d">c</a></li></ol></li>' ELSE '<li><a href="e">e</a></li></ol></li>' END AS nav,
CASE k WHEN 0 THEN '<navPoint id="i' || pos || '"><navLabel><text>&lt;' || pos || '&gt;</text></navLabel><content src="p' || pos || '.xhtml"/>' WHEN 1 THEN '<navPoint id=""><navLabel><text>b</text></navLabel><content src=""/>'
WHEN 2 THEN '<navPoint id=""><navLabel><text>c</text></navLabel><content src="c&amp;d"/></navPoint></navPoint>' ELSE '<navPoint id=""><navLabel><text>e</text></navLabel><content src="e"/></navPoint></navPoint>' END AS ncx, k
FROM {PAGES_SQL}, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT book, md5('<ol>' || string_agg(nav, '' ORDER BY pos, k) || '</ol>') AS nav, md5(string_agg(ncx, '' ORDER BY pos, k)) AS ncx FROM t GROUP BY 1""")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as text of both kinds of navigation: four nodes on three levels for each page of a book."""
    four = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("depth"), F.lit(t).alias("t"), F.lit(h).alias("h")) for k, (d, t, h) in enumerate(((1, "", ""), (2, "b", ""), (3, "c", "c&d"), (2, "e", "e")))])
    n = pages(spark, sf_dir).select("book", "pos", F.inline(four))
    at = F.col("pos").cast("string")
    top = lambda a, b: F.when(F.col("k") == 0, a).otherwise(b)
    n = n.select("book", (F.col("pos") * 4 + F.col("k")).alias("number"), "depth", top(F.concat(F.lit("i"), at), F.lit(None)).alias("nav_id"), top(F.concat(F.lit("<"), at, F.lit(">")), F.col("t")).alias("title"), top(F.concat(F.lit("p"), at, F.lit(".xhtml")), F.col("h")).alias("href"))
    both = N.nav_text(n).withColumnRenamed("text", "nav").join(N.ncx_text(n.withColumnRenamed("href", "src")).withColumnRenamed("text", "ncx"), "book")
    return both.select("book", F.md5(F.col("nav").cast("binary")).alias("nav"), F.md5(F.col("ncx").cast("binary")).alias("ncx"))
