"""The operators on documents as expressions over their trees: no Python on executors, no shuffle, one pass.

They do what ``quire.operators.documents`` does on a parsed tree, over columns of text (``quire.functions.tree`` says where they differ), and over ``content`` of items. Bytes that aren't UTF-8 are replacement
characters, null content is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import html as H
from ..functions import tree as T
from ..functions.tree import let
from .documents import BODY_ATTRIBUTES, GLOBAL_ATTRIBUTES, HEAD_ATTRIBUTES

_DEPRECATED = sorted(C.DEPRECATED_TAGS)


def text_of(content: Column | str) -> Column:
    """The text of a document's bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(F.coalesce(c, F.lit(b"")).cast("string"))


def _allowed(name: Column, table: dict[str, str]) -> Column:
    """The attributes that an element of a name may keep, between spaces."""
    return F.concat(F.lit(" " + " ".join(GLOBAL_ATTRIBUTES) + " "), T.cases(name, table, ""), F.lit(" "))


def _only(attrs: Column, allowed: Column) -> Column:
    return F.filter(attrs, lambda a: F.contains(allowed, F.concat(F.lit(" "), a["k"], F.lit(" "))) | a["k"].startswith("xmlns"))


def _clean(d: Column) -> Column:
    kept = lambda e: ~e["name"].isin(*_DEPRECATED)
    head = lambda i: F.coalesce((i > d["head"]["id"]) & (i < d["head"]["end"]), F.lit(False))
    gone = F.filter(d["e"], lambda e: head(e["id"]) & (e["parent"] == d["head"]["id"]) & ((e["name"] == "meta") | (e["name"] == "title") & (T.text_of(d, e) == "")))
    real = F.exists(d["e"], lambda e: T.in_body(d, e["id"]) & kept(e))

    def done(x: Column) -> Column:
        def attrs(n: Column, i: Column) -> Column:
            return F.when(F.size(n["attrs"]) == 0, n["attrs"]).otherwise(let(T.once(n["attrs"]), lambda a: F.when(head(i), top(n, a)).when(x["real"] & T.in_body(d, i), inner(n, a)).otherwise(a)))

        def top(n: Column, a: Column) -> Column:
            return F.when(n["parent"] == d["head"]["id"], _only(a, _allowed(n["name"], HEAD_ATTRIBUTES))).otherwise(a)

        def inner(n: Column, a: Column) -> Column:
            no_view = F.filter(a, lambda v: ~(F.lower(v["k"]).isin("viewbox", "preserveaspectratio") & (v["v"] != "")))
            border = F.transform(a, lambda v: F.when((n["name"] == "table") & (v["k"] == "border") & (v["v"] == "0"), F.struct(v["k"].alias("k"), F.lit("").alias("v"))).otherwise(v))
            return F.when(n["name"] == "svg", no_view).when(n["name"] == "dl", a).otherwise(_only(border, _allowed(n["name"], BODY_ATTRIBUTES)))

        def caption(n: Column, i: Column) -> Column:
            summary = T.attribute(n["attrs"], "summary")
            return F.when((n["name"] == "table") & x["real"] & T.in_body(d, i) & (summary != ""), F.concat(F.lit("<caption>"), T.escape(summary), F.lit("</caption>")))

        hidden = lambda i: F.exists(x["gone"], lambda e: i.between(e["id"], e["end"] - 1))
        return T.file(d, hidden, attrs=attrs, tag=lambda name: ~name.isin(*_DEPRECATED), after=caption)

    remote = lambda e: (e["name"] == "img") & F.regexp_like(F.lower(F.coalesce(T.attribute(e["attrs"], "src"), F.lit(""))), F.lit("^https?:"))
    found = F.transform(F.filter(d["e"], lambda e: T.in_body(d, e["id"])), lambda e: F.when(e["name"] == "svg", "svg").when(remote(e), "remote-resources"))
    return F.struct(let(F.struct(gone.alias("gone"), real.alias("real")), done).alias("text"), F.array_distinct(F.filter(found, lambda x: x.isNotNull())).alias("properties"))


def clean(text: Column) -> Column:
    """text and properties: a document with deprecated tags gone and attributes whitelisted, and the manifest properties that it needs."""
    return let(T.document(text), _clean)


def rewrite_links(text: Column) -> Column:
    """Links to documents by their file names: paths end in ``.xhtml``, fragments stay, links to notes keep theirs alone; ``name`` becomes ``id``."""

    def rewritten(d: Column) -> Column:
        def attrs(n: Column, i: Column) -> Column:
            return F.when(F.size(n["attrs"]) == 0, n["attrs"]).otherwise(let(T.once(n["attrs"]), lambda a: F.when((n["name"] == "a") & d["real"] & T.in_body(d, i), changed(a)).otherwise(a)))

        def changed(a: Column) -> Column:
            href, name = F.coalesce(T.attribute(a, "href"), F.lit("")), T.attribute(a, "name")
            own = F.transform(a, lambda x: F.when(x["k"] == "href", F.struct(x["k"].alias("k"), H.rewrite_link(x["v"]).alias("v"))).otherwise(x))
            plain = ~F.contains(href, F.lit("InsertNoteID")) & ~F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))
            unnamed = F.filter(own, lambda x: x["k"] != "name")
            id_ = F.struct(F.lit("id").alias("k"), name.alias("v"))
            moved = F.when(F.exists(a, lambda x: x["k"] == "id"), F.transform(unnamed, lambda x: F.when(x["k"] == "id", id_).otherwise(x))).otherwise(F.concat(unnamed, F.array(id_)))
            return F.when(plain & name.isNotNull(), moved).otherwise(own)

        return T.file(d, attrs=attrs)

    return let(T.document(text), rewritten)


def _notes(d: Column) -> Column:
    """id, link (its place) and text of each marked note: markers in order, each with its first link, joined with the last list entry of its id."""
    inner = T.in_body_elements(d)

    def note(e: Column) -> Column:
        uid = T.attribute(e["attrs"], "id")
        own = F.when(F.length(uid) > 8, F.substr(uid, F.lit(1), F.length(uid) - 8)).otherwise("")
        link = T.first(inner, lambda x: (x["name"] == "a") & x["id"].between(e["id"], e["end"] - 1))
        entry = F.element_at(F.concat(F.array(F.lit(None).cast("struct<lead:string>")), F.transform(F.filter(inner, lambda x: (x["name"] == "li") & (T.attribute(x["attrs"], "id") == own)), lambda x: F.struct(x["lead"].alias("lead")))), -1)
        return F.struct(own.alias("id"), link["id"].alias("link"), entry["lead"].alias("text"))

    marks = F.filter(inner, lambda e: (e["name"] == "span") & (T.attribute(e["attrs"], "class") == "InsertNoteMarker"))
    return F.filter(F.transform(marks, note), lambda x: x["link"].isNotNull() & x["text"].isNotNull())


def footnotes(text: Column) -> Column:
    """Marker spans become note references, their notes asides at the end of the body, and the old list goes."""

    def done(d: Column) -> Column:
        lists = F.filter(d["e"], lambda e: (e["name"] == "ol") & (T.attribute(e["attrs"], "id") == "InsertNote_NoteList") & T.in_body(d, e["id"]))
        return let(F.struct(_notes(d).alias("notes"), lists.alias("lists")), lambda x: changed(d, x))

    def changed(d: Column, x: Column) -> Column:
        asides = F.array_join(F.transform(x["notes"], lambda v: F.concat(F.lit('<aside id="'), T.escape(v["id"], quotes=True), F.lit('" epub:type="footnote"><p>'), T.escape(v["text"]), F.lit("</p></aside>"))), "")
        noteref = F.struct(F.lit("epub:type").alias("k"), F.lit("noteref").alias("v"))

        def referring(a: Column) -> Column:
            known = F.exists(a, lambda v: v["k"] == "epub:type")
            return F.when(known, F.transform(a, lambda v: F.when(v["k"] == "epub:type", noteref).otherwise(v))).otherwise(F.concat(a, F.array(noteref)))

        def attrs(n: Column, i: Column) -> Column:
            return F.when((n["name"] == "a") & F.exists(x["notes"], lambda v: v["link"] == i), let(T.once(n["attrs"]), referring)).otherwise(T.once(n["attrs"]))

        return T.file(d, lambda i: F.exists(x["lists"], lambda e: i.between(e["id"], e["end"] - 1)), asides, attrs=attrs)

    return let(T.document(text), done)


def _tag(name: str, attrs: Column) -> Column:
    inner = F.array_join(F.transform(F.map_entries(attrs), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), T.escape(F.coalesce(a["value"], F.lit("")), quotes=True), F.lit('"'))), "")
    return F.concat(F.lit(f"<{name}"), inner, F.lit("/>" if name in ("meta", "link") else f"></{name}>"))


def render(items: DataFrame, language: str) -> DataFrame:
    """The whole document of each HTML item in ``content``: head from its metas, title and links, body from its content. The source's own head is dropped."""
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<map<string,string>>"))
    lang = F.when(F.coalesce("lang", F.lit("")) == "", language).otherwise(F.col("lang"))
    quoted = lambda c: T.escape(c, quotes=True)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("<title>"), T.escape(F.col("title")), F.lit("</title>"))).otherwise("")
    link = lambda x: F.when(F.try_element_at(x, F.lit("type")) == "text/javascript", _tag("script", x)).otherwise(_tag("link", x))
    head = F.concat(F.lit("<head>"), F.array_join(F.transform(some("metas"), lambda m: _tag("meta", m)), ""), title, F.array_join(F.transform(some("links"), link), ""), F.lit("</head>"))
    direction = F.when(F.coalesce("direction", F.lit("")) != "", F.concat(F.lit(' dir="'), quoted(F.col("direction")), F.lit('"'))).otherwise("")
    root = F.concat(F.lit(f'<html xmlns="{C.NAMESPACES["XHTML"]}" xmlns:epub="{C.NAMESPACES["EPUB"]}" lang="'), quoted(lang), F.lit('" xml:lang="'), quoted(lang), F.lit('"'), direction, F.lit(">"))
    inner = let(T.document(text_of("content")), lambda d: T.markup(d, lambda i: T.in_body(d, i)))
    return _changed(items, F.concat(F.lit(T.PROLOGUE), root, head, F.lit("<body"), direction, F.lit(">"), inner, F.lit("</body></html>")))


def _document(kinds: tuple[str, ...] = C.HTML_KINDS) -> Column:
    return F.coalesce(F.col("kind").isin(*kinds), F.lit(False))


def _changed(items: DataFrame, text: Column) -> DataFrame:
    return items.withColumn("content", F.when(_document(), F.encode(text, "UTF-8")).otherwise(F.col("content")))


def clean_items(items: DataFrame) -> DataFrame:
    """Documents of ``items`` cleaned, with the properties that they need after their own."""
    own = items.withColumn("c_", F.when(_document(), clean(text_of("content"))))
    props = F.array_distinct(F.concat(F.coalesce("properties", F.array().cast("array<string>")), F.col("c_.properties")))
    changed = own.withColumns({"content": F.when(_document(), F.encode("c_.text", "UTF-8")).otherwise(F.col("content")), "properties": F.when(_document(), props).otherwise(F.col("properties"))})
    return changed.drop("c_")


def link_items(items: DataFrame) -> DataFrame:
    return _changed(items, rewrite_links(text_of("content")))


def footnote_items(items: DataFrame) -> DataFrame:
    return _changed(items, footnotes(text_of("content")))


def pages_of(items: DataFrame) -> DataFrame:
    """book, doc_pos, n, file_name, fragment, label of each page mark in documents other than navigation."""
    docs = items.where(F.col("kind").isin("html", "cover_html"))
    found = docs.select("book", F.col("pos").cast("int").alias("doc_pos"), "file_name", F.posexplode(let(T.document(text_of("content")), T.pages)).alias("n", "p"))
    return found.select("book", "doc_pos", "n", "file_name", "p.fragment", "p.label")


def bodies(items: DataFrame) -> DataFrame:
    """book, pos, body, heading of each document."""
    of = lambda d: F.struct(T.body(d).alias("body"), F.when(d["body"].isNotNull(), T.heading(d, d["body"])).alias("heading"))
    docs = items.where(_document()).select("book", F.col("pos").cast("int").alias("pos"), let(T.document(text_of("content")), of).alias("b"))
    return docs.select("book", "pos", F.encode("b.body", "UTF-8").alias("body"), "b.heading")


def element_table(items: DataFrame) -> DataFrame:
    """book, pos and every element of each document, as ``quire.functions.tree.elements`` tells them."""
    return T.elements(items.where(_document()), ["book", "pos"], text_of("content"))
