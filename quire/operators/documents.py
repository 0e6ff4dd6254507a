"""Exact operators on documents, over a parsed tree, as Arrow UDFs over one document at a time.

``quire.functions.html`` has flat forms of the extraction operators, without Python, for markup that regular expressions fit.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..batches import runs
from ..functions.dom import Element, document, markup, parse_html

# The attributes that any element may keep, and those of single elements.
GLOBAL_ATTRIBUTES = "accesskey class contenteditable contextmenu dir draggable dropzone hidden id inert itemid itemprop itemref itemscope itemtype lang spellcheck style tabindex title translate epub:type".split()
HEAD_ATTRIBUTES = {
    "base": "href target", "link": "href crossorigin rel media hreflang type sizes", "script": "src type charset async defer crossorigin",
    "source": "src type media", "style": "media type scoped",
}
BODY_ATTRIBUTES = {
    "a": "href target download rel hreflang type", "area": "alt coords shape href target download rel hreflang type",
    "audio": "src crossorigin preload autoplay mediagroup loop muted controls", "blockquote": "cite", "q": "cite",
    "button": "autofocus disabled form formaction formenctype formmethod formnovalidate formtarget name type value menu",
    "canvas": "width height", "del": "cite datetime", "ins": "cite datetime", "details": "open", "embed": "src type width height",
    "fieldset": "disable form name", "form": "accept-charset action autocomplete enctype method name novalidate target",
    "iframe": "src srcdoc name sandbox seamless allowfullscreen width height", "img": "alt src crossorigin usemap ismap width height",
    "input": "accept alt autocomplete autofocus checked dirname disabled form formaction formenctype formmethod formnovalidate formtarget height inputmode list max maxlength min multiple name pattern placeholder readonly required size src steptype value width",
    "keygen": "autofocus challenge disabled form keytype name", "label": "form for", "map": "name", "menu": "type label",
    "object": "data type typemustmatch name usemap form width height", "ol": "reversed start type", "optgroup": "disabled label",
    "option": "disabled label selected value", "output": "for form name", "param": "name value", "progress": "value max",
    "select": "autofocus disabled form multiple name required size", "table": "border sortable", "td": "colspan rowspan headers",
    "textarea": "autocomplete autofocus cols dirname disabled form inputmode maxlength name placeholder readonly required rows wrap",
    "col": "span", "colgroup": "span", "th": "colspan rowspan headers scope abbr sorted", "time": "datetime",
    "track": "kind src srclang label default", "video": "src crossorigin poster preload autoplay mediagroup loop muted controls width height",
}


def body_content(content: bytes | None) -> bytes:
    """The markup in the body: empty without elements in it; a body with attributes keeps its own tag."""
    body = parse_html(content).find("body")
    if body is None or not body.elements():
        return b""
    return (markup(body) if body.attrs else "".join(map(markup, body.kids))).encode()


def heading(elem: Element) -> str | None:
    """The first heading that isn't blank, looking at the first child of each level."""
    for n in range(1, 7):
        h = elem.find(f"h{n}")
        if h is not None and (text := h.text().strip()):
            return text
    return None


def pages(file_name: str, content: bytes | None) -> list[tuple[str, str, str]]:
    """(file, id, label) of each element with an epub:type and an id; the label is its text, else aria-label, else heading, else id."""
    body = parse_html(content).find("body")
    out = []
    for e in body.walk() if body is not None and body.elements() else ():
        if "epub:type" in e.attrs and "id" in e.attrs:
            uid = e.attrs["id"]
            out.append((file_name, uid, e.lead().strip() or e.attrs.get("aria-label") or heading(e) or uid))
    return out


def _root(lang: str, template: bytes | None = None) -> Element:
    """The root of a new document: that of ``template`` with what it holds, else a plain one."""
    root = parse_html(template) if template else Element("html", {"xmlns": C.NAMESPACES["XHTML"], "xmlns:epub": C.NAMESPACES["EPUB"]})
    if template:
        root.kids = [k for k in root.kids if not (isinstance(k, str) and not k.strip()) and not (isinstance(k, Element) and k.name == "body" and not k.attrs and not k.kids)]
    root.attrs |= {"lang": lang, "xml:lang": lang}
    return root


def render(item: dict, language: str, template: bytes | None = None) -> bytes:
    """The whole document of an HTML item: in the root of ``template``, head from its metas, title and links, body from its content. The source's own head is dropped."""
    root = _root(item.get("lang") or language, template)
    head = root.add("head")
    for meta in item.get("metas") or ():
        head.add("meta", dict(meta))
    if item.get("title"):
        head.add("title", text=item["title"])
    for link in item.get("links") or ():
        head.add("script" if dict(link).get("type") == "text/javascript" else "link", dict(link))
    body = root.add("body")
    if item.get("direction"):
        root.attrs["dir"] = body.attrs["dir"] = item["direction"]
    found = parse_html(item.get("content")).find("body")
    if found is not None:
        body.kids = found.kids
    return document(root)


def render_cover(image: str, title: str, language: str, template: bytes | None = None) -> bytes:
    """The cover page that shows ``image``."""
    img = Element("img", {"src": image, "alt": title, "style": "height:100%; text-align:center"})
    root = _root(language, template)
    root.kids += [Element("head", None, *([Element("title", None, title)] if title else [])), Element("body", None, img)]
    return document(root)


def allowed_attributes(attrs: Column | str, tag: str) -> Column:
    """A map of attributes without those that neither any element nor ``tag`` in a body may keep."""
    keep = [*GLOBAL_ATTRIBUTES, *BODY_ATTRIBUTES.get(tag, "").split()]
    return F.map_filter(attrs, lambda k, v: k.isin(*keep) | k.startswith("xmlns"))


def leave_only(e: Element, allowed: str | None) -> None:
    keep = {*GLOBAL_ATTRIBUTES, *(allowed or "").split()}
    e.attrs = {k: v for k, v in e.attrs.items() if k in keep or k.startswith("xmlns")}


def clean(content: bytes | None) -> tuple[bytes, list[str]]:
    """Content with deprecated tags gone and attributes whitelisted, and the manifest properties that it needs."""
    html = parse_html(content)
    found: list[str] = []
    for e in list(html.walk()):
        kids: list = []
        stack = list(reversed(e.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, Element) and k.name in C.DEPRECATED_TAGS:
                stack.extend(reversed(k.kids))
            else:
                kids.append(k)
        e.kids = kids
    head, body = html.find("head"), html.find("body")
    if head is not None and head.elements():
        head.kids = [k for k in head.kids if not (isinstance(k, Element) and (k.name == "meta" or k.name == "title" and k.text() == ""))]
        for e in head.elements():
            leave_only(e, HEAD_ATTRIBUTES.get(e.name))
    if body is None or not body.elements():
        return document(html), found
    stack = list(reversed(body.elements()))
    while stack:
        e = stack.pop()
        if e.name == "svg":
            found.append("svg")
            e.attrs = {k: v for k, v in e.attrs.items() if not v or k.lower() not in ("viewbox", "preserveaspectratio")}
        if e.name == "img" and re.match("https?:", e.attrs.get("src", "").lower()):
            found.append("remote-resources")
        if e.name == "table":
            if e.attrs.get("border") == "0":
                e.attrs["border"] = ""
            if e.attrs.get("summary"):
                e.kids.insert(0, Element("caption", None, e.attrs["summary"]))
        if e.name not in ("dl", "svg"):
            leave_only(e, BODY_ATTRIBUTES.get(e.name))
        stack.extend(reversed(e.elements()))
    return document(html), list(dict.fromkeys(found))


def rewrite_links(content: bytes | None) -> bytes:
    """Links to documents by their file names: paths end in ``.xhtml``, fragments stay, links to notes keep theirs alone; ``name`` becomes ``id``."""
    html = parse_html(content)
    body = html.find("body")
    for a in body.walk() if body is not None and body.elements() else ():
        if a.name != "a":
            continue
        href = a.attrs.get("href", "")
        if "InsertNoteID" in href:
            a.attrs["href"] = "#" + href.partition("#")[2]
            continue
        u = urlparse(href)
        if u.scheme:
            continue
        if u.path:
            a.attrs["href"] = f"{u.path}.xhtml" + (f"#{u.fragment}" if u.fragment else "")
        if "name" in a.attrs:
            a.attrs["id"] = a.attrs.pop("name")
    return document(html)


def footnotes(content: bytes | None) -> bytes:
    """Marker spans become note references, their notes asides at the end of the body, and the old list goes."""
    html = parse_html(content)
    body = html.find("body")
    if body is None or not body.elements():
        return document(html)
    by_id = {e.attrs["id"]: e for e in body.walk() if e.name == "li" and "id" in e.attrs}
    for span in [e for e in body.walk() if e.name == "span" and e.attrs.get("class") == "InsertNoteMarker"]:
        uid = span.attrs.get("id", "")[:-8]
        link = next((e for e in span.walk() if e.name == "a"), None)
        if link is None or uid not in by_id:
            continue
        link.attrs["epub:type"] = "noteref"
        aside = body.add("aside", {"id": uid, "epub:type": "footnote"})
        aside.add("p", text=by_id[uid].lead())
    for parent in list(body.walk()):
        parent.kids = [k for k in parent.kids if not (isinstance(k, Element) and k.name == "ol" and k.attrs.get("id") == "InsertNote_NoteList")]
    return document(html)


CODE_LINK = {"href": "style/code.css", "rel": "stylesheet", "type": "text/css"}


def highlight_source(content: bytes | None) -> tuple[bytes | None, bool]:
    """Content with ``<pre class="source-python">`` and ``source-css`` highlighted, and whether there was any; other languages stay."""
    from pygments import highlight
    from pygments.formatters import HtmlFormatter
    from pygments.lexers import CssLexer, PythonLexer

    html = parse_html(content)
    body, done = html.find("body"), False
    for parent in list(body.walk()) if body is not None else ():
        for i, e in enumerate(parent.kids):
            if isinstance(e, Element) and e.name == "pre" and "source-" in e.attrs.get("class", ""):
                lexer = CssLexer() if "source-css" in e.attrs["class"] else PythonLexer() if "source-python" in e.attrs["class"] else None
                if lexer:
                    made = parse_html(highlight(e.text(), lexer, HtmlFormatter())).find("body")
                    parent.kids[i : i + 1] = made.elements()[:1]
                    done = True
    return (document(html), True) if done else (content, False)


#: Time that tidy has for a document.
TIDY_SECONDS = 60


def tidy(content: bytes, **options: str) -> tuple[int, bytes]:
    """(exit code, output) of an external tidy; (3, the content) where there is none, or where it takes longer than TIDY_SECONDS."""
    args = [x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", v)]
    try:
        done = subprocess.run(["tidy", *args], input=content, capture_output=True, timeout=TIDY_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return 3, content
    return (done.returncode, done.stdout) if done.returncode < 2 else (done.returncode, content)


def map_documents(items: DataFrame, *changes: Callable[[dict], dict], kinds: tuple[str, ...] = C.HTML_KINDS) -> DataFrame:
    """``changes``, one after the other, over each document of ``items`` as a dict, giving the columns that each changes: what per-document hooks are here.

    One pass over the items: other items go through as they are, in Arrow's form; of documents, a run of bounded bytes is held at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(items.schema)
    at, wanted = items.columns.index("kind"), pa.array(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "content"):
                docs = pc.is_in(part.column(at), value_set=wanted)
                if (others := part.filter(pc.invert(docs))).num_rows:
                    yield others.cast(schema)
                out = part.filter(docs).to_pylist()
                for k, row in enumerate(out):
                    for change in changes:
                        out[k] = row = row | change(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)

    return items.mapInArrow(run, items.schema)


def _with_props(row: dict, more: list[str]) -> list[str]:
    return list(dict.fromkeys([*(row["properties"] or []), *more]))


def syntax_hook(row: dict) -> dict:
    content, props = clean(row["content"])
    return {"content": content, "properties": _with_props(row, props)}


def links_hook(row: dict) -> dict:
    return {"content": rewrite_links(row["content"])}


def footnotes_hook(row: dict) -> dict:
    return {"content": footnotes(row["content"])}


def source_hook(row: dict) -> dict:
    content, done = highlight_source(row["content"])
    return {"content": content, "links": [*(row["links"] or []), list(CODE_LINK.items())]} if done else {}


def tidy_hook(row: dict) -> dict:
    return {"content": tidy(row["content"] or b"", char_encoding="utf8", tidy_mark="no")[1]}


def pages_of(items: DataFrame) -> DataFrame:
    """book, doc_pos, n, file_name, fragment, label of each page mark in documents other than navigation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "content"):
                rows = [(r["book"], r["pos"], n, f, i, label) for r in part.to_pylist() for n, (f, i, label) in enumerate(pages(r["file_name"], r["content"]))]
                names = ("book", "doc_pos", "n", "file_name", "fragment", "label")
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))

    docs = items.where(F.col("kind").isin("html", "cover_html")).select("book", F.col("pos").cast("int").alias("pos"), "file_name", "content")
    return docs.mapInArrow(run, "book string, doc_pos int, n int, file_name string, fragment string, label string")


def bodies(items: DataFrame) -> DataFrame:
    """book, pos, body, heading of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "content"):
                found = [(r["book"], r["pos"], body_content(r["content"]), heading(parse_html(r["content"]).find("body") or Element("body"))) for r in part.to_pylist()]
                types = (pa.string(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=["book", "pos", "body", "heading"])

    docs = items.where(F.col("kind").isin(*C.HTML_KINDS)).select("book", F.col("pos").cast("int").alias("pos"), "content")
    return docs.mapInArrow(run, "book string, pos int, body binary, heading string")
