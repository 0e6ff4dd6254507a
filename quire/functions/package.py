"""Package documents in expressions: the text of an XML file as elements, and a package's metadata, manifest, spine, guide and bindings as arrays of rows. No Python.

Tokens are folded as those of HTML are (``tree``), but names keep their case and nothing ends without an end tag, so broken files are recovered in the same way as ``quire.sources.container`` does it: open elements end where their
parent does, stray end tags are dropped. A prefix stands for what the element, its part or the package declares.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..schemas import TABLES
from . import items as I
from . import paths as P
from . import tree as T
from .tree import let

_MARKUP = rf"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<[!?][^>]*+>|</?[A-Za-z_]{T.INSIDE}>|[^<]++|<"
_PAIRS = "array<struct<k:string,v:string>>"


def xml_elements(text: Column) -> Column:
    """The elements of an XML text, as ``tree.spans`` tells them."""

    def token(s: Column) -> Column:
        start, end = F.regexp_like(s, F.lit("^<[A-Za-z_]")), F.regexp_like(s, F.lit("^</"))
        data = s.startswith("<![CDATA[")
        return F.struct(
            F.when(start, F.when(T.ends_itself(s), T.EMPTY).otherwise(T.START)).when(end, T.END).otherwise(T.TEXT).alias("kind"),
            F.when(start | end, F.regexp_extract(s, r"^</?([^\s/>]*)", 1)).otherwise("").alias("name"),
            F.when(start, T.attributes(s)).otherwise(F.array().cast(_PAIRS)).alias("attrs"),
            F.when(data, F.regexp_extract(s, r"(?s)^<!\[CDATA\[(.*?)(?:\]\]>)?\z", 1)).when(start | end | F.regexp_like(s, F.lit("^<[!?]")), "").otherwise(T.unescape(s)).alias("text"),
            F.lit(False).alias("fence"), F.lit("").alias("ended"), F.lit(False).alias("ender"),
        )

    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\x{FEFF}?\s*", "")
    return let(F.transform(F.regexp_extract_all(raw, F.lit(_MARKUP), F.lit(0)), token), lambda ts: let(T.placed(ts), T.spans))


def _local(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def _uri(name: Column, *scopes: Column) -> Column:
    """What an element's prefix stands for (that of a name without one: the default) in the nearest scope, arrays of attributes, that declares it."""
    prefix = F.when(F.contains(name, F.lit(":")), F.concat(F.lit("xmlns:"), F.substring_index(name, ":", 1))).otherwise("xmlns")
    value = lambda attrs: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(attrs, lambda a: a["k"] == prefix), lambda a: a["v"])), -1)
    return F.coalesce(*[value(s) for s in scopes])


def _plain(attrs: Column, *scopes: Column) -> Column:
    """Attributes without declarations, prefixes written out as URIs in braces."""
    kept = F.filter(attrs, lambda a: (a["k"] != "xmlns") & ~a["k"].startswith("xmlns:"))
    uri = lambda a: F.when(a["k"].startswith("xml:"), C.NAMESPACES["XML"]).otherwise(_uri(a["k"], attrs, *scopes))
    return F.transform(kept, lambda a: F.struct(F.when(F.contains(a["k"], F.lit(":")) & uri(a).isNotNull(), F.concat(F.lit("{"), uri(a), F.lit("}"), _local(a["k"]))).otherwise(a["k"]).alias("k"), a["v"].alias("v")))


def package(text: Column) -> Column:
    """A package document as struct: ``metadata``, ``items``, ``spine``, ``guide`` and ``bindings`` with the columns of the corpus tables that it tells, ``book`` and ``error``, which part is missing."""

    def of(es: Column) -> Column:
        def found(root: Column) -> Column:
            child = lambda name: T.first(es, lambda e: (e["parent"] == root["id"]) & (_local(e["name"]) == name)).alias(name)
            return let(F.struct(root.alias("root"), *[child(name) for name in ("metadata", "manifest", "spine", "guide", "bindings")]), lambda p: parts(es, p))

        return let(F.get(es, F.lit(0)), found)

    def parts(es: Column, p: Column) -> Column:
        below = lambda part: F.coalesce(F.filter(es, lambda e: e["parent"] == p[part]["id"]), F.array().cast(T.SPAN))
        a = T.attribute
        scopes = (p["metadata"]["attrs"], p["root"]["attrs"])
        meta = F.transform(below("metadata"), lambda e, i: F.struct(i.alias("seq"), _uri(e["name"], e["attrs"], *scopes).alias("ns"), _local(e["name"]).alias("name"), F.nullif(e["lead"], F.lit("")).alias("value"), _plain(e["attrs"], *scopes).alias("attrs")))

        def item(e: Column, i: Column) -> Column:
            media = I.manifest_media_type(F.coalesce(a(e["attrs"], "media-type"), F.lit("")))
            props = F.filter(F.split(F.coalesce(a(e["attrs"], "properties"), F.lit("")), " "), lambda x: x != "")
            kind = I.manifest_kind(media, props)
            return F.struct(
                i.alias("pos"), kind.alias("kind"), a(e["attrs"], "id").alias("id"), P.url_decode(F.coalesce(a(e["attrs"], "href"), F.lit(""))).alias("file_name"), F.coalesce(F.nullif(media, F.lit("")), F.lit(C.DEFAULT_MEDIA_TYPE)).alias("media_type"),
                (kind != "cover_html").alias("is_linear"), a(e["attrs"], "media-overlay").alias("media_overlay"), a(e["attrs"], "duration").alias("media_duration"), props.alias("properties"),
            )

        items = F.transform(F.filter(below("manifest"), lambda e: _local(e["name"]) == "item"), item)
        spine = F.transform(below("spine"), lambda e, i: F.struct(i.alias("pos"), a(e["attrs"], "idref").alias("idref"), F.coalesce(a(e["attrs"], "linear"), F.lit("yes")).alias("linear")))
        guide = F.transform(below("guide"), lambda e, i: F.struct(i.alias("pos"), *[a(e["attrs"], c).alias(c) for c in ("href", "title", "type")]))
        bindings = F.transform(below("bindings"), lambda e, i: F.struct(i.alias("pos"), F.map_from_entries(T.once(_plain(e["attrs"], p["bindings"]["attrs"], p["root"]["attrs"]))).alias("attrs")))
        identifier = F.coalesce(F.nullif(a(p["root"]["attrs"], "unique-identifier"), F.lit("")), F.lit("id"))

        def told(m: Column) -> Column:
            dc = lambda name: F.filter(m, lambda x: (x["ns"] == C.NAMESPACES["DC"]) & (x["name"] == name))
            own = F.filter(dc("identifier"), lambda x: a(x["attrs"], "id") == identifier)
            book = F.struct(
                a(p["root"]["attrs"], "version").alias("version"), identifier.alias("identifier_id"), F.when(F.size(own) > 0, F.element_at(own, -1)["value"]).alias("uid"),
                F.when(F.size(dc("title")) > 0, F.get(dc("title"), F.lit(0))["value"]).otherwise("").alias("title"), F.when(F.size(dc("language")) > 0, F.get(dc("language"), F.lit(0))["value"]).otherwise("en").alias("language"),
                a(p["spine"]["attrs"], "page-progression-direction").alias("direction"),
            )
            missing = F.when(p["root"].isNull(), "no element found")
            for part in ("metadata", "manifest", "spine"):
                missing = missing.when(p[part].isNull(), f"Can not find {part} element")
            return F.struct(m.alias("metadata"), items.alias("items"), spine.alias("spine"), guide.alias("guide"), bindings.alias("bindings"), book.alias("book"), missing.alias("error"))

        return let(meta, told)

    return let(xml_elements(text), of)


def package_tables(texts: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """metadata, items, spine, guide, bindings and books of ``texts`` (book, ``text``: its package document), each with the columns of the corpus table that a package tells. A package without one of its parts gives no
    rows but one of ``books``, which says so."""
    parsed = texts.select("book", package(F.col(text)).alias("p_"))
    out = {t: parsed.where("p_.error IS NULL").select("book", F.inline(F.col(f"p_.{t}"))) for t in ("metadata", "items", "spine", "guide", "bindings")}
    out["books"] = parsed.select("book", *[F.when(F.col("p_.error").isNull(), F.col(f"p_.book.{c}")).alias(c) for c in ("version", "identifier_id", "uid", "title", "language", "direction")], F.when(F.col("p_.error").isNotNull(), -1).alias("error_code"), F.col("p_.error").alias("error"))
    order = {t: [c.split()[0] for c in re.split(r", (?=\w+ \w)", s)] for t, s in TABLES.items()}
    return {t: df.select(*[c for c in order[t] if c in df.columns]) for t, df in out.items()}
