"""A small tree for HTML and XHTML, on the standard library's tokenizer.

Lenient: void elements need no end, some elements end where others begin, stray end tags are dropped. Names of
attributes keep their case, which the tokenizer alone would lose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an open element of the key's name is ended by.
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "optgroup": frozenset(("optgroup",)), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "thead": frozenset(("tbody", "tfoot")), "tbody": frozenset(("tbody", "tfoot")), "tfoot": frozenset(("tbody",)), "colgroup": frozenset(("colgroup", "thead", "tbody", "tfoot", "tr")), "caption": frozenset(("colgroup", "thead", "tbody", "tfoot", "tr")),
    "rt": frozenset(("rt", "rp")), "rp": frozenset(("rt", "rp")),
}
#: Elements that an implied end doesn't look beyond.
FENCES = frozenset("ol ul dl table select ruby body html nav div section".split())
_NAME = re.compile(r"""[\s/]([^\s/>="']+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?""")


class Element:
    """An element: ``name``, ``attrs`` in order, and ``kids``, elements and strings."""

    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, *kids: Element | str):
        self.name, self.attrs, self.kids = name, dict(attrs or {}), list(kids)

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def walk(self) -> Iterator[Element]:
        """The element and all below it, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed(e.elements()))

    def find(self, name: str) -> Element | None:
        return next((k for k in self.elements() if k.name == name), None)

    def text(self) -> str:
        """All text below, in order."""
        out, stack = [], [self]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                stack.extend(reversed(k.kids))
        return "".join(out)

    def lead(self) -> str:
        """Text before the first element."""
        out = []
        for k in self.kids:
            if isinstance(k, Element):
                break
            out.append(k)
        return "".join(out)

    def parents(self) -> dict[int, Element]:
        """Each element's parent, by the element's id()."""
        return {id(k): e for e in self.walk() for k in e.elements()}

    def add(self, name: str, attrs: dict[str, str] | None = None, text: str | None = None) -> Element:
        e = Element(name, attrs, *([text] if text else []))
        self.kids.append(e)
        return e


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.stack = [self.root]

    def _begin(self, tag: str, attrs: list[tuple[str, str | None]]) -> Element:
        raw = self.get_starttag_text() or ""
        cased = {n.lower(): n for n in _NAME.findall(raw[1 + len(tag) :])}
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.stack[depth].name
            if tag in ENDED_BY.get(name, ()):  # and what that ends in turn: a row ends the last cell and the last row
                del self.stack[depth:]
            elif name in FENCES:
                break
        e = Element(tag, {cased.get(k, k): v if v is not None else "" for k, v in attrs})
        self.stack[-1].kids.append(e)
        return e

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = self._begin(tag, attrs)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag, attrs)
        if tag in ("script", "style"):
            self.clear_cdata_mode()

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == tag:
                del self.stack[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].kids.append(data)


def parse_html(source: bytes | str | None) -> Element:
    """The document as a tree: its html element, made up with a body where the source is a fragment."""
    text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source or ""
    b = _Builder()
    b.feed(text.lstrip("﻿"))
    b.close()
    html = b.root.find("html")
    if html is None:
        html = Element("html")
        head = [k for k in b.root.elements() if k.name in ("head",)]
        body = b.root.find("body")
        html.kids = head + ([body] if body else [Element("body", None, *[k for k in b.root.kids if k not in head])])
    return html


def markup(node: Element | str) -> str:
    """XHTML text of a tree."""
    if isinstance(node, str):
        return escape(node, quote=False)
    out: list[str] = []
    stack: list[Element | str | tuple[str]] = [node]
    while stack:
        k = stack.pop()
        if isinstance(k, tuple):
            out.append(k[0])
        elif isinstance(k, str):
            out.append(escape(k, quote=False))
        else:
            attrs = "".join(f' {n}="{escape(v)}"' for n, v in k.attrs.items())
            if not k.kids and k.name in VOID:
                out.append(f"<{k.name}{attrs}/>")
                continue
            out.append(f"<{k.name}{attrs}>")
            stack.append((f"</{k.name}>",))
            stack.extend(reversed(k.kids))
    return "".join(out)


def document(html: Element) -> bytes:
    """A tree as an XHTML file."""
    return ('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n' + markup(html)).encode()
