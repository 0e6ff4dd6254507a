"""The exact document operators over the whole html of pages, with notes, code, old markup and links to be changed in it.

The SQL follows the text of a page, which no operator but the one for notes may change, and what each operator is for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..operators import documents as D
from ..operators import hooks
from ..schemas import TABLES
from .containers import query, shaped
from .tables import PAGES_SQL, pages

_LIST = '<ol id="InsertNote_NoteList"><li id="InsertNoteID_{k}">Note {k}<span>back</span></li></ol>'
_MORE = (
    '<font color="red"><p bgcolor="x">Old <big>text</big> {k}</p></font>'
    '<p>n<span id="InsertNoteID_{k}_marker1" class="InsertNoteMarker"><sup><a href="p.xhtml#InsertNoteID_{k}">1</a></sup></span></p>' + _LIST + '<pre class="source-python">x = {k}</pre></article>'
)
#: Names in text, and what they stand for; that of the ampersand comes last.
_NAMED = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"))


def _sql(text: str) -> str:
    return "'" + text.replace("{k}", "' || pos || '") + "'"


_W = f"(SELECT book, pos, html AS plain, replace(html, '</article>', {_sql(_MORE)}) AS w FROM {PAGES_SQL})"


def _text_sql(html: str) -> str:
    """The text of a page's body."""
    out = f"regexp_replace(regexp_extract({html}, '<body>(.*)', 1, 's'), '<!--.*?-->|<[^>]*>', '', 'gs')"
    for name, char in _NAMED:
        out = f"replace({out}, '{name}', '{char}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    first, *rest = _MORE.split("{k}")
    more = F.concat(F.lit(first), *[x for part in rest for x in (F.col("pos").cast("string"), F.lit(part))])
    content = F.encode(F.replace("html", F.lit("</article>"), more), "UTF-8")
    name = F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(".xhtml"))
    return shaped(p, TABLES["items"], book=F.col("book"), pos=F.col("pos"), kind=F.lit("html"), id=F.col("pos").cast("string"), file_name=name, media_type=F.lit(C.XHTML_TYPE), properties=F.array().cast("array<string>"), content=content)


def _body(content: Column) -> Column:
    return F.regexp_extract(content, "(?s)<body[^>]*>(.*)</body>", 1)


def _text(body: Column) -> Column:
    out = F.regexp_replace(body, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.md5(out.cast("binary"))


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what)).cast("long")


def _done(items: DataFrame) -> DataFrame:
    return items.withColumn("c", F.decode("content", "UTF-8")).withColumn("pos", F.col("pos").cast("long")).withColumn("digest", _text(_body(F.col("c"))))


@query(f"SELECT book, pos::BIGINT AS pos, md5({_text_sql('w')}) AS digest, len(regexp_extract_all(regexp_extract(w, '<body>(.*)', 1, 's'), '<[a-zA-Z]'))::BIGINT AS n_elements FROM {_W}")
def whole_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markup in the body: all of its text, and an element for each that begins."""
    body = F.decode("body", "UTF-8")
    return D.bodies(_items(spark, sf_dir)).select("book", F.col("pos").cast("long").alias("pos"), _text(body).alias("digest"), _count(body, "<[a-zA-Z]").alias("n_elements"))


@query(f"SELECT book, pos::BIGINT AS pos, md5({_text_sql('w')}) AS digest, len(regexp_extract_all(regexp_extract(w, '<body>(.*)', 1, 's'), '<[a-zA-Z]'))::BIGINT - 2 AS n_elements, 0::BIGINT AS n_metas, 0::BIGINT AS n_unknown FROM {_W}")
def whole_syntax_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deprecated tags, metas and unknown attributes gone, and nothing else."""
    done = _done(hooks.Syntax().html_before_write(_items(spark, sf_dir)))
    return done.select("book", "pos", "digest", _count(_body(F.col("c")), "<[a-zA-Z]").alias("n_elements"), _count(F.col("c"), "<meta").alias("n_metas"), _count(F.col("c"), "bgcolor|color=").alias("n_unknown"))


@query(f"""WITH l AS (SELECT book, pos, regexp_extract_all(w, '<a href="([^"]*)"', 1) AS links FROM {_W}), u AS (SELECT book, pos, unnest(links) AS href, generate_subscripts(links, 1) - 1 AS n FROM l)
SELECT book, pos::BIGINT AS pos, n::BIGINT AS n, CASE WHEN href LIKE '%InsertNoteID%' THEN '#' || split_part(href, '#', 2) ELSE href || '.xhtml' END AS href FROM u""")
def whole_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page, by the name of its document; links to notes stay in theirs."""
    done = _done(hooks.DocumentLinks().html_before_write(_items(spark, sf_dir)))
    links = F.regexp_extract_all("c", F.lit("(<a [^>]*>)"), F.lit(1))
    return done.select("book", "pos", F.posexplode(links).alias("n", "a")).select("book", "pos", F.col("n").cast("long").alias("n"), H.href(F.col("a")).alias("href"))


@query(f"SELECT book, pos::BIGINT AS pos, md5({_text_sql(f'''replace(w, {_sql(_LIST)}, '')''')} || 'Note ' || pos) AS digest, 'InsertNoteID_' || pos AS id, 1::BIGINT AS n_refs FROM {_W}")
def whole_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's note goes from its list to the end of the body."""
    done = _done(hooks.Footnotes().html_before_write(_items(spark, sf_dir)))
    return done.select("book", "pos", "digest", F.regexp_extract("c", '<aside id="([^"]*)" epub:type="footnote">', 1).alias("id"), _count(F.col("c"), 'epub:type="noteref"').alias("n_refs"))


@query(f"SELECT book, pos::BIGINT AS pos, md5({_text_sql('''replace(w, '</pre>', chr(10) || '</pre>')''')}) AS digest, 1::BIGINT AS n_blocks, 'style/code.css' AS link FROM {_W}")
def whole_source_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code highlighted where it stands in a page; the highlighter ends it with a line feed."""
    done = _done(hooks.SourceHighlight().html_before_write(_items(spark, sf_dir)))
    return done.select("book", "pos", "digest", _count(F.col("c"), '<div class="highlight">').alias("n_blocks"), F.get("links", F.lit(0))["href"].alias("link"))


@query(f"SELECT book, pos::BIGINT AS pos, md5({_text_sql('w')}) AS digest, 'Page ' || pos AS title, 0::BIGINT AS n_own FROM {_W}")
def whole_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rendered with their own body and a new head."""
    own = _items(spark, sf_dir).withColumn("title", F.concat(F.lit("Page "), F.col("pos").cast("string")))
    done = _done(D.map_documents(own, lambda r: {"content": D.render(r, "en")}))
    return done.select("book", "pos", "digest", F.regexp_extract("c", "<title>([^<]*)</title>", 1).alias("title"), _count(F.col("c"), "<style|<script|<meta").alias("n_own"))
