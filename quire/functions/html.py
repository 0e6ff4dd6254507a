"""Flat HTML expressions: regular expressions over one document, for corpora whose markup they fit.

``quire.operators.documents`` has the same operators exactly, on a parsed tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEPRECATED_TAGS
from .paths import _c

TAG = "<[^>]*>"


def text_of(fragment: Column) -> Column:
    """Text without tags, trimmed, white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, TAG, ""), r"[\x20\x09-\x0D]+", " "))


def body(html: Column | str) -> Column:
    """What is between the body tags; empty where there is no body or no element in it."""
    inner = F.regexp_extract(_c(html), r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(F.regexp_like(inner, F.lit("<[A-Za-z]")), inner).otherwise("")


def heading(html: Column | str) -> Column:
    """The first heading that isn't blank, the higher level first; null where there is none."""
    found = [F.nullif(text_of(F.regexp_extract(_c(html), rf"(?is)<h{i}(?:\s[^>]*)?>(.*?)</h{i}>", 1)), F.lit("")) for i in range(1, 7)]
    return F.coalesce(*found)


def nav_links(html: Column | str) -> Column:
    """The anchors of the first nav element, as tags with their content."""
    nav = F.regexp_extract(_c(html), r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    return F.regexp_extract_all(nav, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))


def href(anchor: Column) -> Column:
    return F.regexp_extract(anchor, r'(?is)href="([^"]*)"', 1)


def strip_deprecated(html: Column | str) -> Column:
    """Deprecated tags removed, their text kept."""
    return F.regexp_replace(_c(html), rf"(?i)</?(?:{'|'.join(DEPRECATED_TAGS)})(?:\s[^>]*)?/?>", "")


def rewrite_link(link: Column | str) -> Column:
    """A link without scheme as the name of a document: its path with ``.xhtml`` and its fragment; query, parameters and host are dropped. A link to a note keeps its fragment alone."""
    h = _c(link)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, "#.*$", ""), r"\?.*$", ""), "^//[^/]*", "")
    path = F.regexp_replace(path, ";[^/]*$", "")
    fragment = F.regexp_extract(h, "(#.*)$", 1)
    made = F.when(path == "", h).otherwise(F.concat(path, F.lit(".xhtml"), fragment))
    made = F.when(F.regexp_like(h, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), h).otherwise(made)
    return F.when(F.contains(h, F.lit("InsertNoteID")), fragment).otherwise(made)


def escape(value: Column | str) -> Column:
    v = _c(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def pagebreak(pageref: Column | str, label: Column | str | None = None) -> Column:
    """The span of a page break; the label, where there is one, is its text."""
    p = _c(pageref)
    shown = F.coalesce(_c(label) if label is not None else F.lit(None).cast("string"), F.lit(""))
    tag = F.concat(F.lit('<span xmlns:epub="http://www.idpf.org/2007/ops" epub:type="pagebreak" title="'), escape(p), F.lit('" id="'), escape(p), F.lit('"'))
    return F.when(shown == "", F.concat(tag, F.lit("/>"))).otherwise(F.concat(tag, F.lit(">"), F.replace(F.replace(F.replace(shown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</span>")))


def page_tags(html: Column | str) -> Column:
    """The elements with an epub:type and an id, each as its start tag and the text up to the next tag."""
    return F.regexp_extract_all(_c(html), F.lit(r'(<[A-Za-z][^>]*epub:type="[^"]*"[^>]*>[^<]*)'), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1)
