"""Trees of HTML in expressions: a token stream, folded with a stack of open elements into an array of nodes. No Python, no shuffle.

``nodes`` gives a document's tokens in order. Each knows its tag's name and attributes, the text that it stands for, the element that it is in (``parent``, by its place from 1 on; 0: none), its depth, and the elements
that end before it, also where nothing says so: an open paragraph, cell or list entry ends where what follows ends it, by the table that ``dom`` has too. ``elements`` makes rows of them.

The operators on documents (body, page marks, clean-up, links, notes, rendering) are expressions over that array; ``quire.operators.documents`` has them on a parsed tree, and tests hold one against the other.
Differences: an end of a quoted attribute that never comes makes the tag text; entities are those of HTML 4, and numbers; comments, declarations and processing instructions are dropped by both.
"""

from __future__ import annotations

import html.entities as names
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .dom import ENDED_BY, FENCES, VOID

INSIDE = r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+"""
#: Comments; declarations and instructions; scripts and styles with what they hold; tags; text; a mark that begins nothing.
_MARKUP = rf"(?is)<!--.*?(?:-->|\z)|<(?:[!?]|/(?![a-z]))[^>]*+>|<(?:script|style)(?=[\s/>]){INSIDE}(?<!/)>.*?(?=</(?:script|style)|\z)|</?[a-z]{INSIDE}>|[^<]++|<"
TAG = rf"^<{INSIDE}>"
_ATTRIBUTE = r"""[\s/][^\s/>="']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
_ENDERS = sorted({n for ended in ENDED_BY.values() for n in ended})
#: Tokens that one step of the outer fold takes; arrays grow by so many at a time.
BLOCK = 128

TEXT, START, EMPTY, END = 0, 1, 2, 3


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cases(name: Column, table: dict[str, str], other: str) -> Column:
    """The value of a name in a table, by text of the form ``;name=value;``, which is one search."""
    said = ";" + ";".join(f"{k}={v}" for k, v in table.items()) + ";"
    at = F.instr(F.lit(said), F.concat(F.lit(";"), name, F.lit("=")))
    return F.when(at > 0, F.substring_index(F.substr(F.lit(said), at + F.length(name) + 2), ";", 1)).otherwise(other)


def unescape(text: Column) -> Column:
    """Text with its entities resolved; those that some names have without a semicolon too."""
    known = {n: chr(c) for n, c in names.name2codepoint.items()}
    table = F.create_map(*[F.lit(x) for n, c in known.items() for x in (n, c)])
    legacy = sorted((n for n in names.html5 if not n.endswith(";")), key=len, reverse=True)
    bare = F.create_map(*[F.lit(x) for n in legacy for x in (n, names.html5[n])])

    def number(digits: Column, base: int) -> Column:
        n = F.conv(digits, base, 10).cast("decimal(20,0)")
        char = F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
        return F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�").otherwise(char)

    def one(piece: Column) -> Column:
        hexa, deci = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]{1,9});?", 1), F.regexp_extract(piece, "^#([0-9]{1,9});?", 1)
        named, short = F.try_element_at(table, F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)), F.regexp_extract(piece, f"^(?:{'|'.join(legacy)})", 0)
        rest = lambda p: F.regexp_replace(piece, p, "")
        return (
            F.when(hexa != "", F.concat(number(hexa, 16), rest("^#[xX][0-9a-fA-F]+;?")))
            .when(deci != "", F.concat(number(deci, 10), rest("^#[0-9]+;?")))
            .when(named.isNotNull(), F.concat(named, rest("^[A-Za-z0-9]+;")))
            .when(short != "", F.concat(F.element_at(bare, short), F.substr(piece, F.length(short) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    parts = lambda t: F.concat(F.get(t, F.lit(0)), F.array_join(F.transform(F.slice(t, 2, F.size(t)), one), ""))
    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), parts)).otherwise(text)


def escape(text: Column, quotes: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ends_itself(tag: Column) -> Column:
    """Whether a tag ends with a slash that isn't part of an unquoted value."""
    return tag.endswith("/>") & ~F.regexp_like(tag, F.lit(r"""=\s*[^\s"'>]+/>$"""))


def attributes(tag: Column) -> Column:
    """Names and values in order; of names that are given twice the first place has the last value."""

    def pair(piece: Column) -> Column:
        value = F.regexp_replace(piece, r"^[\s/][^\s/>=\"']+(?:\s*=\s*)?", "")
        quoted = F.regexp_like(value, F.lit("^[\"']"))
        return F.struct(F.regexp_extract(piece, r"^[\s/]([^\s/>=\"']+)", 1).alias("k"), unescape(F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)).alias("v"))

    inner = F.regexp_replace(F.regexp_replace(tag, "^<[A-Za-z][^\\s/>]*", ""), ">$", "")
    inner = F.when(ends_itself(tag), F.regexp_replace(inner, "/$", "")).otherwise(inner)
    found = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), pair)
    return F.when(F.contains(tag, F.lit("=")) | F.regexp_like(tag, F.lit(r"\s")), found).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def tokens(text: Column) -> Column:
    """kind, name, attrs and text of each token, and what the fold needs: fence, ended (names that end it)."""

    def token(s: Column) -> Column:
        start, end = F.regexp_like(s, F.lit("^<[A-Za-z]")), F.regexp_like(s, F.lit("^</[A-Za-z]"))
        name = F.when(start | end, F.lower(F.regexp_extract(s, r"^</?([A-Za-z][^\s/>]*)", 1))).otherwise("")
        tag = F.when(start, F.regexp_extract(s, TAG, 0)).otherwise("")
        return let(F.struct(name.alias("name"), tag.alias("tag"), start.alias("start"), end.alias("end")), lambda x: F.struct(
            F.when(x["start"], F.when(ends_itself(x["tag"]) | x["name"].isin(*sorted(VOID)), EMPTY).otherwise(START)).when(x["end"], END).otherwise(TEXT).alias("kind"),
            x["name"].alias("name"),
            F.when(x["start"], attributes(x["tag"])).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("attrs"),
            F.when(x["start"], F.substr(s, F.length(x["tag"]) + 1)).when(x["end"] | F.regexp_like(s, F.lit("^<[!?/]")), "").otherwise(unescape(s)).alias("text"),
            x["name"].isin(*sorted(FENCES)).alias("fence"),
            F.when(x["start"], cases(x["name"], {n: "," + ",".join(sorted(e)) + "," for n, e in ENDED_BY.items()}, "")).otherwise("").alias("ended"),
            (x["start"] & x["name"].isin(*_ENDERS)).alias("ender"),
        ))

    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿+", ""), F.lit(_MARKUP), F.lit(0)), token)


_STACK = "array<struct<id:int,name:string,fence:boolean,ended:string>>"
_OUT = "array<struct<parent:int,depth:int,closed:array<struct<id:int,name:string>>>>"


def fold(ts: Column) -> Column:
    """parent, depth and closed of each token, and of what is still open behind the last one."""

    def cut(stack: Column, t: Column) -> Column:
        """The place in the stack that this token ends open elements from."""
        n = F.size(stack)
        fence = F.coalesce(F.array_max(F.transform(stack, lambda x, i: F.when(x["fence"], i + 1).otherwise(0))), F.lit(0))
        ended = lambda f: F.array_min(F.transform(stack, lambda x, i: F.when((i + 1 > f) & F.contains(x["ended"], F.concat(F.lit(","), t["name"], F.lit(","))), i + 1)))
        named = F.array_max(F.transform(stack, lambda x, i: F.when(x["name"] == t["name"], i + 1)))
        return F.when(t["ender"], F.coalesce(let(fence, ended), n + 1)).when(t["kind"] == END, F.coalesce(named, n + 1)).otherwise(n + 1)

    def step(state: Column, t: Column) -> Column:
        stack = state["stack"]

        def made(k: Column) -> Column:
            rest = F.slice(stack, F.lit(1), k - 1)
            gone = F.transform(F.reverse(F.slice(stack, k, F.size(stack) - k + 1)), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
            parent = F.coalesce(F.get(stack, k - 2)["id"], F.lit(0))
            own = F.array(F.struct((state["n"] + 1).alias("id"), t["name"].alias("name"), t["fence"].alias("fence"), t["ended"].alias("ended")))
            return F.struct(
                F.when(t["kind"] == START, F.concat(rest, own)).otherwise(rest).cast(_STACK).alias("stack"),
                F.concat(state["out"], F.array(F.struct(parent.alias("parent"), (k - 1).cast("int").alias("depth"), gone.alias("closed")))).cast(_OUT).alias("out"),
                (state["n"] + 1).alias("n"),
            )

        return let(cut(stack, t), made)

    empty = F.array().cast(_OUT)

    def block(state: Column, first: Column) -> Column:
        begun = F.struct(state["stack"].alias("stack"), empty.alias("out"), state["n"].alias("n"))
        done = F.aggregate(F.slice(ts, first, F.lit(BLOCK)), begun, step)
        return let(done, lambda d: F.struct(d["stack"].alias("stack"), F.concat(state["out"], d["out"]).alias("out"), d["n"].alias("n")))

    start = F.struct(F.array().cast(_STACK).alias("stack"), empty.alias("out"), F.lit(0).alias("n"))
    firsts = F.when(F.size(ts) > 0, F.sequence(F.lit(1), F.size(ts), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, start, block, lambda s: F.concat(s["out"], F.array(F.struct(F.lit(0).alias("parent"), F.lit(0).alias("depth"), F.transform(F.reverse(s["stack"]), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("closed"))).cast(_OUT)))


def nodes(text: Column) -> Column:
    """The tokens of a document with parent, depth and closed; the last one has no token of its own, but closes what is still open."""
    return let(tokens(text), placed)


def placed(ts: Column) -> Column:
    """Tokens with what the fold tells of them."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    last = F.struct(F.lit(TEXT).alias("kind"), F.lit("").alias("name"), none.alias("attrs"), F.lit("").alias("text"))
    own = F.concat(F.transform(ts, lambda t: F.struct(t["kind"].alias("kind"), t["name"].alias("name"), t["attrs"].alias("attrs"), t["text"].alias("text"))), F.array(last))
    return F.zip_with(own, fold(ts), lambda t, o: F.struct(*[t[c].alias(c) for c in ("kind", "name", "attrs", "text")], *[o[c].alias(c) for c in ("parent", "depth", "closed")]))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, null where there is none; of several the last."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(attrs, lambda a: a["k"] == name), lambda a: a["v"])), -1)


SPAN = "array<struct<id:int,end:int,parent:int,depth:int,name:string,attrs:array<struct<k:string,v:string>>,lead:string>>"


def spans(ns: Column) -> Column:
    """The elements of a document's nodes, in order: id (the place of the tag), end (the place of what ends it), parent, depth, name, attrs and lead (text before the first element in it)."""

    def begun(n: Column, i: Column) -> Column:
        return F.when(n["kind"].isin(START, EMPTY), F.struct((i + 1).alias("id"), n.alias("n")))

    ends = F.flatten(F.transform(ns, lambda n, i: F.concat(
        F.transform(n["closed"], lambda c: F.struct(c["id"].alias("id"), (i + 1).alias("end"))),
        F.when(n["kind"] == EMPTY, F.array(F.struct((i + 1).alias("id"), (i + 2).alias("end")))).otherwise(F.array().cast("array<struct<id:int,end:int>>")),
    )))

    def joined(starts: Column, sorted_ends: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            end = F.get(sorted_ends, j)["end"]
            stop = F.least(F.coalesce(F.get(starts, j + 1)["id"], F.size(ns) + 1), end)
            after = F.slice(ns, s["id"] + 1, F.greatest(stop - s["id"] - 1, F.lit(0)))
            lead = F.when(s["n"]["kind"] == EMPTY, "").otherwise(F.concat(s["n"]["text"], F.array_join(F.transform(after, lambda x: x["text"]), "")))
            return F.struct(s["id"].alias("id"), end.alias("end"), *[s["n"][c].alias(c) for c in ("parent", "depth", "name", "attrs")], lead.alias("lead"))

        return F.transform(starts, one).cast(SPAN)

    # Each element has one end, so sorted by their elements ends stand beside them.
    return let(F.filter(F.transform(ns, begun), lambda x: x.isNotNull()), lambda starts: let(F.array_sort(ends), lambda e: joined(starts, e)))


def document(text: Column) -> Column:
    """A document as struct: ``n``, its nodes, ``e``, its elements, its parts ``html``, ``head`` and ``body`` (elements, null where there is none), and ``real``, whether there is a body with an element in it.
    Without an html element, one around all of it is meant, and a body around all but the ``heads``."""

    def parts(ns: Column) -> Column:
        return let(spans(ns), lambda es: let(first(es, lambda e: (e["name"] == "html") & (e["parent"] == 0)), lambda top: let(F.struct(
            ns.alias("n"), es.alias("e"), top.alias("html"),
            first(es, lambda e: (e["name"] == "head") & (e["parent"] == F.coalesce(top["id"], F.lit(0)))).alias("head"),
            first(es, lambda e: (e["name"] == "body") & (e["parent"] == F.coalesce(top["id"], F.lit(0)))).alias("body"),
            F.filter(es, lambda e: (e["name"] == "head") & (e["parent"] == 0)).alias("heads"),
        ), lambda d: d.withField("real", F.exists(d["e"], lambda e: in_body(d, e["id"]))))))

    return let(nodes(text), parts)


def first(es: Column, fits: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(es, fits), F.lit(0))


def elements(docs: DataFrame, keys: list[str], text: Column | str) -> DataFrame:
    """The element table: a row for each element with ``keys`` and what ``spans`` tells of it."""
    column = F.col(text) if isinstance(text, str) else text
    return docs.select(*keys, F.inline(let(nodes(column), spans)))


#: What Python's ``strip`` takes for white space.
_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}", ""), rf"{_SPACE}\z", "")


def text_of(d: Column, e: Column) -> Column:
    """All text of an element."""
    return F.array_join(F.transform(F.slice(d["n"], e["id"], e["end"] - e["id"]), lambda n: n["text"]), "")


def _made_up(d: Column) -> Column:
    return d["html"].isNull() & d["body"].isNull()


def in_body(d: Column, place: Column) -> Column:
    """Whether a place lies in the body, which it isn't itself."""
    return F.when(_made_up(d), ~F.exists(d["heads"], lambda e: place.between(e["id"], e["end"] - 1))).otherwise(F.coalesce((place > d["body"]["id"]) & (place < d["body"]["end"]), F.lit(False)))


def in_body_elements(d: Column) -> Column:
    """The body's elements, it first; none if it has none in it."""
    own = F.filter(d["e"], lambda e: in_body(d, e["id"]))
    return F.when(F.size(own) > 0, F.when(d["body"].isNotNull(), F.concat(F.array(d["body"]), own)).otherwise(own)).otherwise(F.array().cast(SPAN))


def heading(d: Column, e: Column) -> Column:
    """The first heading of an element that isn't blank, looking at the first child of each level."""
    of = lambda k: first(d["e"], lambda x: (x["parent"] == e["id"]) & (x["name"] == f"h{k}"))
    return F.coalesce(*[let(of(k), lambda h: F.nullif(strip(text_of(d, h)), F.lit(""))) for k in range(1, 7)])


def pages(d: Column) -> Column:
    """fragment and label of each element with an epub:type and an id: its text, else aria-label, else heading, else the id."""
    marked = F.filter(in_body_elements(d), lambda e: attribute(e["attrs"], "epub:type").isNotNull() & attribute(e["attrs"], "id").isNotNull())
    label = lambda e: F.coalesce(F.nullif(strip(e["lead"]), F.lit("")), F.nullif(attribute(e["attrs"], "aria-label"), F.lit("")), heading(d, e), attribute(e["attrs"], "id"))
    return F.transform(marked, lambda e: F.struct(attribute(e["attrs"], "id").alias("fragment"), label(e).alias("label")))


def _opened(name: Column, attrs: Column, empty: Column) -> Column:
    inner = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["k"], F.lit('="'), escape(a["v"], quotes=True), F.lit('"'))), "")
    end = F.when(empty & name.isin(*sorted(VOID)), "/>").otherwise(F.when(empty, F.concat(F.lit("></"), name, F.lit(">"))).otherwise(">"))
    return F.concat(F.lit("<"), name, inner, end)


def once(attrs: Column) -> Column:
    """Attributes with each name once, in its first place, with its last value."""

    def single(a: Column) -> Column:
        keys = F.array_distinct(F.transform(a, lambda x: x["k"]))
        return F.when(F.size(keys) == F.size(a), a).otherwise(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(a, lambda x: x["k"] == k), -1)["v"].alias("v"))))

    return F.when(F.size(attrs) < 2, attrs).otherwise(let(attrs, single))


def markup(d: Column, shown: Callable[[Column], Column], attrs: Callable[[Column, Column], Column] | None = None, tag: Callable[[Column], Column] | None = None, after: Callable[[Column, Column], Column] | None = None, last: Column | None = None) -> Column:
    """The markup of the places that are ``shown``. ``attrs`` gives a node's attributes, each name once (node, place), ``tag`` says by name whether an element's tags are written, ``after`` what follows a node's tag (node, place), and
    ``last`` what goes before the body's end."""
    tag = tag or (lambda name: F.lit(True))
    before = lambda c: F.when(c["id"] == d["body"]["id"], last).otherwise("") if last is not None else F.lit("")

    def one(n: Column, i: Column) -> Column:
        ends = F.transform(F.filter(n["closed"], lambda c: shown(c["id"]) & tag(c["name"])), lambda c: F.concat(before(c), F.lit("</"), c["name"], F.lit(">")))
        start = n["kind"].isin(START, EMPTY) & tag(n["name"])
        opened = F.when(start, _opened(n["name"], (attrs(n, i + 1) if attrs else once(n["attrs"])), n["kind"] == EMPTY)).otherwise("")
        own = F.concat(opened, *([F.coalesce(after(n, i + 1), F.lit(""))] if after else []), escape(n["text"]))
        return F.concat(F.array_join(ends, ""), F.when(shown(i + 1), own).otherwise(""))

    return F.array_join(F.transform(d["n"], one), "")


def body(d: Column) -> Column:
    """The markup in the body: empty without elements in it; a body with attributes keeps its own tag."""
    own = F.coalesce(F.size(d["body"]["attrs"]) > 0, F.lit(False))
    inner = markup(d, lambda i: in_body(d, i))
    opened = F.when(own, _opened(F.lit("body"), once(d["body"]["attrs"]), F.lit(False))).otherwise("")
    return F.when(d["real"], F.concat(opened, inner, F.when(own, "</body>").otherwise(""))).otherwise("")


PROLOGUE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n'


def file(d: Column, hidden: Callable[[Column], Column] | None = None, last: Column | None = None, **how) -> Column:
    """A document as an XHTML file, without the places that are ``hidden``; ``last`` goes at the end of its body, ``how`` to ``markup``."""
    hidden = hidden or (lambda i: F.lit(False))
    part = lambda name: lambda i: F.coalesce(i.between(d[name]["id"], d[name]["end"] - 1), F.lit(False)) & ~hidden(i)
    written = lambda shown: markup(d, shown, last=last, **how)
    made = F.concat(F.lit("<body>"), written(lambda i: in_body(d, i) & ~hidden(i)), last if last is not None else F.lit(""), F.lit("</body>"))
    loose = F.concat(F.lit("<html>"), written(part("head")), F.when(d["body"].isNull(), made).otherwise(written(part("body"))), F.lit("</html>"))
    return F.concat(F.lit(PROLOGUE), F.when(d["html"].isNotNull(), written(part("html"))).otherwise(loose))
