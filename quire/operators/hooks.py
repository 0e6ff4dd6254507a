"""Hooks on a corpus: what plugins are here.

A hook is any object with some of ``after_read`` and ``before_write`` (corpus -> corpus), ``html_after_read`` and
``html_before_write`` (items -> items; documents of any kind, navigation and cover pages too), and ``document_after_read`` and ``document_before_write`` (one document as a dict -> the columns that change).
Hooks on single documents that follow each other run in one pass over the items, however many they are. Other names are never called.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from ..sources.reader import Corpus
from . import documents as D


def _apply(corpus: Corpus, hooks: Iterable, phase: str) -> Corpus:
    hooks = list(hooks)
    for h in hooks:
        if hasattr(h, phase):
            corpus = getattr(h, phase)(corpus)
    items, changes = corpus.items, []
    for h in hooks:
        if hasattr(h, f"document_{phase}"):
            changes.append(getattr(h, f"document_{phase}"))
        elif hasattr(h, f"html_{phase}"):
            items = getattr(h, f"html_{phase}")(D.map_documents(items, *changes) if changes else items)
            changes = []
    if changes:
        items = D.map_documents(items, *changes)
    return corpus if items is corpus.items else replace(corpus, items=items)


def after_read(corpus: Corpus, hooks: Iterable) -> Corpus:
    return _apply(corpus, hooks, "after_read")


def before_write(corpus: Corpus, hooks: Iterable) -> Corpus:
    return _apply(corpus, hooks, "before_write")


class Documents:
    """A hook on single documents; over items on its own too."""

    def html_before_write(self, items):
        return D.map_documents(items, self.document_before_write)


class Syntax(Documents):
    """Deprecated tags and unknown attributes removed before writing."""

    document_before_write = staticmethod(D.syntax_hook)


class DocumentLinks(Documents):
    """Links between documents by file name."""

    document_before_write = staticmethod(D.links_hook)


class Footnotes(Documents):
    """Marked notes as asides."""

    document_before_write = staticmethod(D.footnotes_hook)


class SourceHighlight(Documents):
    """Embedded Python and CSS highlighted."""

    document_before_write = staticmethod(D.source_hook)


class Tidy(Documents):
    """An external tidy over documents, read or written; content stays where there is none."""

    document_before_write = document_after_read = staticmethod(D.tidy_hook)

    def html_after_read(self, items):
        return D.map_documents(items, self.document_after_read)
