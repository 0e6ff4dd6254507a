"""A container's tables: the bytes of one book in, rows of the schemas out. No Spark here; sources call it on executors."""

from __future__ import annotations

import html
import io
import lzma
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable
from typing import IO
from urllib.parse import unquote

from .. import constants as C
from ..functions.dom import Element, parse_html

NS = C.NAMESPACES


class BookError(Exception):
    """A book that can't be read: ``code`` is 0 for a broken archive, 1 for one that is too large, -1 for missing parts."""

    def __init__(self, code: int, said: str):
        super().__init__(said)
        self.code, self.said = code, said


_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<![^>]*>?|</\s*(?P<end>[^\s<>/]+)[^<>]*>?|<(?P<start>[A-Za-z_][^\s<>/="']*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*?)(?P<empty>/?)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")


def recover_xml(text: str) -> ET.Element:
    """The tree of broken XML: open elements end where their parent does, stray end tags and what follows the root are dropped, stray marks are text, unquoted and empty attributes count."""
    root, stack, spaces, at = None, [], [{"xml": NS["XML"]}], 0

    def named(name: str, scope: dict, plain: str | None) -> str:
        prefix, colon, local = name.partition(":")
        uri = scope.get(prefix) if colon else plain
        return f"{{{uri}}}{local if colon else name}" if uri else name

    def put(data: str) -> None:
        if stack and data:
            e = stack[-1][1]
            if len(e):
                e[-1].tail = (e[-1].tail or "") + data
            else:
                e.text = (e.text or "") + data

    for m in _MARKUP.finditer(text):
        put(html.unescape(text[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            put(m["cdata"])
        elif m["end"]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == m["end"]), None)
            if depth is not None:
                del stack[depth:], spaces[depth + 1 :]
                if not stack:
                    break
        elif m["start"]:
            given = [(k, html.unescape(a or b or c)) for k, a, b, c in _ATTRIBUTE.findall(m["attrs"])]
            scope = spaces[-1] | {k.partition(":")[2]: v for k, v in given if k == "xmlns" or k.startswith("xmlns:")}
            e = ET.Element(named(m["start"], scope, scope.get("")), {named(k, scope, None): v for k, v in given if k != "xmlns" and not k.startswith("xmlns:")})
            if stack:
                stack[-1][1].append(e)
            elif root is None:
                root = e
            if not m["empty"]:
                stack.append((m["start"], e))
                spaces.append(scope)
    if root is None:
        raise ET.ParseError("no element found")
    return root


def parse_xml(raw: bytes) -> ET.Element:
    """The root of an XML file, also of a broken one; document types are dropped, so no entity of theirs expands."""
    text = re.sub(rb"<!DOCTYPE[^>\[]*(\[.*?\]\s*)?>", b"", raw, count=1, flags=re.S).lstrip(b"\xef\xbb\xbf \t\r\n")
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return recover_xml(text.decode("utf-8", "replace"))


class Archive:
    """Reads entries of an archive, given as bytes or as a file that can seek: of the latter, its directory and the entries asked for. What is wrong with an entry is told in one way, whoever reads it."""

    def __init__(self, source: bytes | IO[bytes]):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
        except zipfile.LargeZipFile:
            raise BookError(1, "Large Zip file") from None
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            raise BookError(0, "Bad Zip file") from None

    def look(self, name: str) -> str:
        """The entry's name in the directory; an error where that tells already that it can't be read."""
        name = posixpath.normpath(name)
        info = self.zip.getinfo(name)
        if info.flag_bits & 1:
            raise BookError(-1, f"{name} is encrypted")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            raise BookError(-1, f"{name} is compressed in an unknown way")
        return name

    def __call__(self, name: str) -> bytes:
        name = self.look(name)
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, EOFError, lzma.LZMAError, OSError, ValueError, NotImplementedError, RuntimeError):
            raise BookError(-1, f"{name} is damaged") from None


archive_reader = Archive


def folder_reader(folder: str, fs=None) -> Callable[[str], bytes]:
    """Reads files of an unpacked book, of the local file system or of ``fs``; names that lead out of its folder are refused."""
    top = os.path.realpath(folder) if fs is None else folder.rstrip("/")

    def read(name: str) -> bytes:
        path = os.path.realpath(os.path.join(top, name)) if fs is None else posixpath.normpath(posixpath.join(top, name))
        if path != top and not path.startswith(top + "/"):
            raise OSError(f"{name!r} escapes the book's folder")
        if fs is not None:
            with fs.open_input_file(path) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()

    def look(name: str) -> None:
        path = posixpath.normpath(posixpath.join(top, name))
        if fs is None and not os.path.isfile(path) or fs is not None and not fs.get_file_info(path).is_file:
            raise FileNotFoundError(name)

    read.look = look
    return read


def _local(tag: str) -> tuple[str | None, str]:
    ns, _, name = tag.rpartition("}")
    return (ns[1:] or None) if ns else None, name


def package_path(read: Callable[[str], bytes]) -> str:
    """Where the package document is: the last root file of its media type."""
    try:
        root = parse_xml(read(C.CONTAINER_PATH))
    except (KeyError, FileNotFoundError):
        raise BookError(-1, "Can not find container file") from None
    found = [e.get("full-path") or "" for e in root.iter() if _local(e.tag)[1] == "rootfile" and e.get("media-type") == C.OPF_TYPE]
    if not found:
        raise BookError(-1, "Can not find container file")
    return found[-1]


def _kind(media_type: str, properties: list[str]) -> str:
    match media_type:
        case C.NCX_TYPE:
            return "ncx"
        case C.SMIL_TYPE:
            return "smil"
        case C.XHTML_TYPE:
            return "nav" if "nav" in properties else "cover_html" if "cover" in properties else "html"
    if media_type in C.IMAGE_TYPES:
        return "cover" if "cover-image" in properties else "image"
    return "item"


def _toc_rows(book: str, nodes: list[tuple]) -> list[tuple]:
    """Rows of nodes (depth from 0, title, href, uid, whether it is a section), which are in pre-order."""
    rows, path = [], []
    for depth, title, href, uid, section in nodes:
        path = [*path[:depth], path[depth] + 1 if depth < len(path) else 0]
        rows.append((book, list(path), path[:-1], len(path), "section" if section else "link", title, href, uid))
    return rows


def ncx_nodes(raw: bytes) -> list[tuple]:
    """The navigation points in pre-order, as ``_toc_rows`` takes them; of any depth."""
    points = lambda parent: [p for p in (parent if parent is not None else ()) if isinstance(p.tag, str) and _local(p.tag)[1] == "navPoint"]
    out, stack = [], [(p, 0) for p in reversed(points(parse_xml(raw).find(f"{{{NS['DAISY']}}}navMap")))]
    while stack:
        p, depth = stack.pop()
        label, content, kids = p.find(f"{{{NS['DAISY']}}}navLabel/{{{NS['DAISY']}}}text"), p.find(f"{{{NS['DAISY']}}}content"), points(p)
        out.append((depth, label.text if label is not None else "", content.get("src", "") if content is not None else "", None if kids else p.get("id", ""), bool(kids)))
        stack += [(k, depth + 1) for k in reversed(kids)]
    return out


def _link(base: str, href: str) -> str:
    return href if re.match("[A-Za-z][A-Za-z0-9+.-]*:", href) else posixpath.normpath(posixpath.join(base, href))


def nav_nodes(raw: bytes, base: str, kind: str = "toc") -> list[tuple]:
    """The entries of a navigation document's list of ``kind`` in pre-order, as ``_toc_rows`` takes them; of any depth."""
    nav = next((e for e in parse_html(raw).walk() if e.name == "nav" and kind in e.attrs.values()), None)
    entries = lambda ol: [e for e in (ol.elements() if ol else ()) if e.name == "li"]
    out, stack = [], [(li, 0) for li in reversed(entries(nav.find("ol")))] if nav is not None else []
    while stack:
        li, depth = stack.pop()
        inner, a = li.find("ol"), li.find("a")
        href = _link(base, a.attrs["href"]) if a is not None and a.attrs.get("href") else ""
        if inner is not None:
            first = li.elements()[0]
            out.append((depth, first.text() if first is not inner else "", href, None, True))
            stack += [(k, depth + 1) for k in reversed(entries(inner))]
        elif href:
            out.append((depth, a.text(), href, None, False))
    return out


def read_tables(book: str, read: Callable[[str], bytes], ignore_ncx: bool = True, content: bool = True, keep: bool = True) -> dict[str, list[tuple]]:
    """Rows of every table of one book. With ``content`` every entry of the manifest is read, so that what can't be read is told; without ``keep`` the bytes aren't handed on. Without ``content`` entries are
    looked up alone."""
    opf = package_path(read)
    try:
        root = parse_xml(read(opf))
    except (KeyError, FileNotFoundError):
        raise BookError(-1, "Can not find container file") from None
    base = posixpath.dirname(opf)
    part = lambda name: root.find(f"{{{NS['OPF']}}}{name}")

    look = getattr(read, "look", read)

    def load(name: str, whole: bool = True) -> bytes:
        try:
            return (read if whole else look)(posixpath.join(base, name))
        except (KeyError, FileNotFoundError):
            raise BookError(-1, f"Can not find {name}") from None

    metadata = []
    if (found := part("metadata")) is None:
        raise BookError(-1, "Can not find metadata element")
    for e in found:
        if isinstance(e.tag, str):
            ns, name = _local(e.tag)
            metadata.append((book, len(metadata), ns, name, e.text, [(("{%s}%s" % _local(k) if k.startswith("{") else k), v) for k, v in e.items()]))
    dc = lambda name: [(m[4], dict(m[5])) for m in metadata if m[2] == NS["DC"] and m[3] == name]
    identifier = root.get("unique-identifier") or "id"
    uid = [v for v, a in dc("identifier") if a.get("id") == identifier]

    if (found := part("manifest")) is None:
        raise BookError(-1, "Can not find manifest element")
    items = []
    for e in found:
        if e.tag != f"{{{NS['OPF']}}}item":
            continue
        href, media = unquote(e.get("href") or ""), e.get("media-type") or ""
        media = "image/jpeg" if media == "image/jpg" else media
        props = [p for p in (e.get("properties") or "").split(" ") if p]
        kind = _kind(media, props)
        raw = load(href, content)
        items.append((book, len(items), kind, e.get("id"), href, media or C.DEFAULT_MEDIA_TYPE, kind != "cover_html", True, "Cover" if kind == "cover_html" else "", "", None, e.get("media-overlay"), e.get("duration"), props, [], [], raw if content and keep else None))
    ids = {}
    for i in items:
        ids.setdefault(i[3], i)

    if (found := part("spine")) is None:
        raise BookError(-1, "Can not find spine element")
    spine = [(book, n, e.get("idref"), e.get("linear", "yes")) for n, e in enumerate(found)]
    nav = next((i for i in items if i[2] == "nav"), None)
    toc: list = []
    if found.get("toc") and (not ignore_ncx or nav is None):
        if found.get("toc") not in ids:
            raise BookError(-1, "Can not find ncx file.")
        toc = ncx_nodes(load(ids[found.get("toc")][4]))
    pages = []
    if nav is not None:
        raw, folder = load(nav[4]), posixpath.dirname(nav[4])
        if ignore_ncx or not toc:
            toc = nav_nodes(raw, folder)
        for _, title, href, _, _ in nav_nodes(raw, folder, "page-list"):
            if href:
                name, mark, fragment = href.partition("#")
                one = mark and "#" not in fragment
                pages.append((book, len(pages), name if one else href, fragment if one else None, title))
    guide = [(book, n, e.get("href"), e.get("title"), e.get("type"), None) for n, e in enumerate(part("guide") if part("guide") is not None else ())]
    bindings = [(book, n, dict(e.items())) for n, e in enumerate(part("bindings") if part("bindings") is not None else ())]
    title, language = dc("title"), dc("language")
    row = (book, root.get("version"), identifier, uid[-1] if uid else None, title[0][0] if title else "", language[0][0] if language else "en", found.get("page-progression-direction"), base, [], {}, {}, None, None)
    return {"books": [row], "metadata": metadata, "items": items, "spine": spine, "toc": _toc_rows(book, toc), "guide": guide, "page_list": pages, "bindings": bindings}


def failed(book: str, e: Exception) -> dict[str, list[tuple]]:
    """The tables of a book that can't be read: its row says why."""
    code = e.code if isinstance(e, BookError) else -1
    return {"books": [(book, None, None, None, None, None, None, None, None, None, None, code, str(e) or type(e).__name__)]}
