"""Containers from tables: the package document, navigation and archive of each book."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import replace
from datetime import UTC, datetime
from html import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dom import Element, document, markup
from ..operators.documents import pages as page_marks
from ..operators.documents import _root as new_root
from ..operators.documents import render, render_cover
from ..schemas import TABLES
from ..workdir import written
from .entries import file_system
from .reader import Corpus, _arrow, file_name

NS = C.NAMESPACES
#: Options of a container and their defaults. ``mtime`` is the modification time (none: now).
OPTIONS = {
    "epub2_guide": True, "epub3_landmark": True, "epub3_pages": True, "landmark_title": "Guide", "pages_title": "Pages", "spine_direction": True,
    "package_direction": False, "play_order": False, "play_order_start": 1, "compresslevel": 6, "mtime": None, "render": True,
}


def entry_time(t: datetime) -> tuple[int, ...]:
    """The time of an archive entry: an aware time as local, never before 1980."""
    local = t.astimezone() if t.tzinfo else t
    return max((1980, 1, 1, 0, 0, 0), tuple(local.timetuple()[:6]))


def modified(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def relative(target: str, folder: str) -> str:
    return target if re.match("[A-Za-z][A-Za-z0-9+.-]*:", target) else posixpath.relpath(target, folder or ".")


def _tag(name: str, attrs: dict[str, str | None], text: str | None = None) -> str:
    inner = "".join(f' {k}="{escape(v)}"' for k, v in attrs.items() if v is not None)
    return f"<{name}{inner}>{escape(text, quote=False)}</{name}>" if text else f"<{name}{inner}/>"


def _attrs(pairs) -> dict[str, str]:
    short = {NS["OPF"]: "opf", NS["XML"]: "xml"}
    out = {}
    for p in pairs or ():
        ns, _, name = p["k"].rpartition("}")
        out[f"{short[ns[1:]]}:{name}" if ns and ns[1:] in short else name] = p["v"] or ""
    return out


def package(book: dict, mtime: datetime, o: dict) -> bytes:
    """The package document of a book: its row with the lists of its other tables."""
    attrs = {"xmlns": NS["OPF"], "unique-identifier": book["identifier_id"] or "id", "version": "3.0", "prefix": " ".join(["rendition: http://www.idpf.org/vocab/rendition/#", *(book["prefixes"] or ())])}
    if book["direction"] and o["package_direction"]:
        attrs["dir"] = book["direction"]
    spaces = {"xmlns:dc": NS["DC"], "xmlns:opf": NS["OPF"], **{f"xmlns:{k}": v for k, v in (book["namespaces"] or {}).items()}}
    names = {v: k.removeprefix("xmlns:") for k, v in spaces.items()}
    meta = [_tag("meta", {"property": "dcterms:modified"}, modified(mtime))]
    for m in book["metadata"]:
        a = _attrs(m["attrs"])
        if m["ns"] == NS["OPF"]:
            if a.get("property") != "dcterms:modified":
                meta.append(_tag("meta", a, m["value"]))
        elif m["ns"] is None:
            meta.append(_tag(m["name"], a, m["value"]))
        else:
            prefix = names.setdefault(m["ns"], f"ns{len(names)}")
            spaces[f"xmlns:{prefix}"] = m["ns"]
            meta.append(_tag(f"{prefix}:{m['name']}", a, m["value"]))
    manifest, ncx, ids = [], None, {}
    for i in book["items"]:
        ids.setdefault(i["id"], i)
        if not i["manifest"]:
            continue
        a = {"href": i["file_name"], "id": i["id"] or "", "media-type": i["media_type"]}
        match i["kind"]:
            case "nav":
                a["properties"] = "nav"
            case "cover":
                a["properties"] = "cover-image"
            case "ncx":
                ncx = i["id"]
            case _:
                a |= {"properties": " ".join(i["properties"] or ()) or None, "media-overlay": i["media_overlay"], "duration": i["media_duration"]}
        manifest.append(_tag("item", a))
    spine = []
    for s in book["spine"]:
        i = ids.get(s["idref"])
        no = i is not None and (i["is_linear"] is False or s["linear"] == "no")
        spine.append(_tag("itemref", {"idref": s["idref"] or "", "linear": "no" if no else None}))
    direction = book["direction"] if o["spine_direction"] else None
    head = f'<spine{f" toc=\"{escape(ncx)}\"" if ncx else ""}{f" page-progression-direction=\"{escape(direction)}\"" if direction else ""}>'
    guide = [_tag("reference", {"type": t, "title": title, "href": href}) for t, title, href in guide_entries(book)] if o["epub2_guide"] else []
    bindings = [_tag("mediaType", dict(b["attrs"])) for b in book["bindings"]]
    own = "".join(f' {k}="{escape(v)}"' for k, v in attrs.items())
    return "\n".join([
        '<?xml version="1.0" encoding="utf-8"?>', f"<package{own}>", "<metadata" + "".join(f' {k}="{escape(v)}"' for k, v in spaces.items()) + ">", *meta, "</metadata>",
        "<manifest>", *manifest, "</manifest>", head, *spine, "</spine>",
        *(["<guide>", *guide, "</guide>"] if guide else []), *(["<bindings>", *bindings, "</bindings>"] if bindings else []), "</package>",
    ]).encode()


def guide_entries(book: dict) -> list[tuple[str, str, str]]:
    """(type, title, href) of guide references; an item's own go before given ones."""
    ids: dict = {}
    for i in book["items"]:
        ids.setdefault(i["id"], i)
    out = []
    for g in book["guide"]:
        i = ids.get(g["item_id"]) if g["item_id"] else None
        out.append((g["type"] or "", (i["title"] if i else g["title"]) or "", (i["file_name"] if i else g["href"]) or ""))
    return out


def _tree(book: dict) -> list[dict]:
    """The table of contents in pre-order, each node with its depth from 0, whether it has others below it, and the link of the first leaf right below; a node with an item's id takes its file and title
    where it lacks its own, and one whose parent isn't there stands at the top."""
    nodes: dict[tuple, dict] = {}
    ids = {i["id"]: i for i in reversed(book["items"])}
    for t in sorted(book["toc"], key=lambda t: t["path"]):
        i = ids.get(t["uid"]) if t["node_kind"] in ("document", "document_section") else None
        parent = nodes.get(tuple(t["path"][:-1]))
        n = {"kind": t["node_kind"], "title": t["title"] or (i["title"] if i else "") or "", "href": t["href"] or (i["file_name"] if i else "") or "", "uid": t["uid"], "depth": parent["depth"] + 1 if parent else 0, "inner": t["node_kind"] in ("section", "document_section"), "kids": False, "below": "", "parent": parent}
        nodes[tuple(t["path"])] = n
        if parent:
            parent["kids"] = parent["inner"] = True
    out = list(nodes.values())
    for n in out:
        if n["parent"] and not n["kids"] and not n["parent"]["below"]:
            n["parent"]["below"] = n["href"]
    return out


def navigation(book: dict, nav: dict, o: dict) -> bytes:
    """The navigation document: contents, landmarks and page list."""
    folder, title = posixpath.dirname(nav["file_name"]), nav["title"] or book["title"] or ""
    root = new_root(book["language"] or "en", dict(book.get("templates") or {}).get("nav"))
    head = root.add("head")
    head.add("title", text=title)
    for link in nav["links"] or ():
        head.add("link", {"href": dict(link).get("href", ""), "rel": "stylesheet", "type": "text/css"})
    body = root.add("body", {"dir": nav["direction"]} if nav["direction"] else None)
    toc = body.add("nav", {"epub:type": "toc", "id": "id", "role": "doc-toc"})
    toc.add("h2", text=title)

    lists = {0: toc.add("ol")}
    for n in _tree(book):
        li = lists[n["depth"]].add("li")
        li.add("a", {"href": relative(n["href"], folder)}, n["title"]) if n["href"] else li.add("span", None, n["title"])
        if n["inner"]:
            lists[n["depth"] + 1] = li.add("ol")
    marks = [g for g in guide_entries(book) if g[2]]
    if book["guide"] and o["epub3_landmark"]:
        land = body.add("nav", {"epub:type": "landmarks"})
        land.add("h2", text=o["landmark_title"])
        ol = land.add("ol")
        for kind, text, href in marks:
            ol.add("li").add("a", {"epub:type": C.LANDMARKS.get(kind, kind), "href": relative(href, folder)}, text)
    if o["epub3_pages"]:
        found = [p for i in book["items"] if i["kind"] in ("html", "cover_html") for p in page_marks(i["file_name"], i["content"])]
        if found:
            own = body.add("nav", {"epub:type": "page-list", "id": "pages", "hidden": "hidden"})
            own.add("h2", text=o["pages_title"])
            ol = own.add("ol")
            for name, uid, label in found:
                ol.add("li").add("a", {"href": relative(f"{name}#{uid}", folder)}, label)
    return document(root)


def ncx(book: dict, o: dict) -> bytes:
    """The older navigation file; sections without a link take that of the first leaf right below."""
    points, open_, sections = [], 0, 0
    for order, n in enumerate(_tree(book), int(o["play_order_start"])):
        points += ["</navPoint>"] * (open_ - n["depth"])
        uid = f"sep_{sections}" if n["inner"] and n["kind"] != "document_section" else n["uid"] or ""
        sections += n["inner"]
        points += [_tag("navPoint", {"id": uid, "playOrder": str(order) if o["play_order"] else None})[:-2] + ">", "<navLabel>", _tag("text", {}, n["title"]), "</navLabel>", _tag("content", {"src": n["href"] or n["below"]})]
        open_ = n["depth"] + 1
    points += ["</navPoint>"] * open_
    template = dict(book.get("templates") or {}).get("ncx")
    start = [bytes(template).decode("utf-8", "replace").rpartition("</")[0]] if template else ['<?xml version="1.0" encoding="utf-8"?>', f'<ncx xmlns="{NS["DAISY"]}" version="2005-1">']
    return "\n".join([
        *start, "<head>", _tag("meta", {"content": book["uid"] or "", "name": "dtb:uid"}), _tag("meta", {"content": "0", "name": "dtb:depth"}),
        _tag("meta", {"content": "0", "name": "dtb:totalPageCount"}), _tag("meta", {"content": "0", "name": "dtb:maxPageNumber"}), "</head>",
        "<docTitle>", _tag("text", {}, book["title"]), "</docTitle>", "<navMap>", *points, "</navMap>", "</ncx>",
    ]).encode()


def build(book: dict, options: dict | None = None) -> bytes:
    """The container of one book: its row, with ``metadata``, ``items``, ``spine``, ``toc``, ``guide``, ``page_list`` and ``bindings`` as lists of dicts in order."""
    o = OPTIONS | (options or {})
    mtime = o["mtime"] or datetime.now(UTC)
    mtime = datetime.fromisoformat(mtime) if isinstance(mtime, str) else mtime
    folder = book["folder"] if book["folder"] is not None else "EPUB"
    at = lambda name: f"{folder}/{name}" if folder else name
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=int(o["compresslevel"])) as z:

        def put(name: str, data: bytes, stored: bool = False) -> None:
            info = zipfile.ZipInfo(name, entry_time(mtime))
            info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)

        put("mimetype", b"application/epub+zip", stored=True)
        put(C.CONTAINER_PATH, f'<?xml version="1.0" encoding="utf-8"?>\n<container xmlns="{NS["CONTAINERNS"]}" version="1.0"><rootfiles><rootfile media-type="{C.OPF_TYPE}" full-path="{escape(at("content.opf"))}"/></rootfiles></container>'.encode())
        put(at("content.opf"), package(book, mtime, o))
        templates = dict(book.get("templates") or {})
        cover = next((i["file_name"] for i in book["items"] if i["kind"] == "cover"), "")
        for i in book["items"]:
            match i["kind"]:
                case "ncx":
                    data = ncx(book, o)
                case "nav":
                    data = navigation(book, i, o)
                case "html" if o["render"]:
                    data = render(i, book["language"] or "en", templates.get("chapter"))
                case "cover_html" if o["render"] and not i["content"]:
                    data = render_cover(cover, i["title"] or "", book["language"] or "en", templates.get("cover"))
                case _:
                    data = i["content"] or b""
            put(at(i["file_name"]) if i["manifest"] else i["file_name"], data)
    return out.getvalue()


def nested(corpus: Corpus) -> DataFrame:
    """A row a book with its other tables as ordered arrays of structs. A container is one file, so a book's rows do meet in one task; books are dealt by hash."""
    out = corpus.books.where("error_code IS NULL").drop("error_code", "error")
    order = {"metadata": "seq", "toc": "path"}
    for t in TABLES:
        if t == "books":
            continue
        df = getattr(corpus, t)
        by: Column | str = order.get(t, "pos")
        rest = [c for c in df.columns if c != "book"]
        rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o_"), F.struct(*rest).alias("r_"))), lambda a, b: F.when(a["o_"] < b["o_"], -1).when(a["o_"] > b["o_"], 1).otherwise(0))
        out = out.join(df.groupBy("book").agg(F.transform(rows, lambda x: x["r_"]).alias(t)), "book", "left")
    return out


def _plain(r: dict) -> dict:
    """A row of ``nested`` as ``build`` takes it."""
    for t in TABLES:
        if t != "books":
            r[t] = r[t] or []
    for i in r["items"]:
        i["links"], i["metas"] = [dict(x) for x in i["links"] or ()], [dict(x) for x in i["metas"] or ()]
    for b in r["bindings"]:
        b["attrs"] = dict(b["attrs"] or {})
    r["namespaces"], r["templates"] = dict(r["namespaces"] or {}), dict(r["templates"] or {})
    return r


def pack(corpus: Corpus, options: dict | None = None) -> DataFrame:
    """book, data: each book's container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = _plain(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([r["book"]]), pa.array([build(r, options)], pa.binary())], names=["book", "data"])

    return nested(corpus).mapInArrow(run, "book string, data binary")


def file_names(corpus: Corpus) -> DataFrame:
    """book, file, refused: where each book goes below a folder, and why it can't. Names keep their folders, but for those that all books share; two books that would be one file, and one outside of the folder, are
    refused."""
    name = F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace("book", "^[A-Za-z][A-Za-z0-9+.-]*:/*", ""), "^/+|/+$", ""), r"\.epub$", ""), F.lit(".epub"))
    books = corpus.books.where("error_code IS NULL").select("book", name.alias("file"))
    ends = books.agg(F.min("file").alias("a"), F.max("file").alias("b")).first()
    shared = os.path.commonprefix([ends["a"] or "", ends["b"] or ""]).rpartition("/")[0]
    books = books.withColumn("file", F.substr("file", F.lit(len(shared) + 2 if shared else 1)))
    twice = books.groupBy("file").agg(F.count("*").alias("n")).where("n > 1")
    refused = F.when(F.concat(F.lit("/"), "file", F.lit("/")).contains("/../"), F.concat(F.col("file"), F.lit(" leads outside of the folder"))).when(F.col("n") > 1, F.concat("n", F.lit(" books would be "), "file", F.lit(": they can't be written under one name")))
    return books.join(twice, "file", "left").select("book", "file", refused.alias("refused"))


WRITTEN = "book string, file string, bytes long, error_code int, error string"


def _moved(fs, tmp: str, to: str) -> None:
    """A file of an attempt goes to its place; where an earlier try has moved it already, that stands."""
    if not fs.get_file_info(tmp).is_file and fs.get_file_info(to).is_file:
        return
    fs.create_dir(posixpath.dirname(to), recursive=True)
    try:
        fs.move(tmp, to)
    except OSError:  # some file systems don't move onto a file
        fs.copy_file(tmp, to)
        fs.delete_file(tmp)


def write_books(corpus: Corpus, path: str, options: dict | None = None) -> DataFrame:
    """Write every book of ``corpus`` below ``path`` (a path, or a URI that pyarrow opens on the executors); a row of WRITTEN for each book says where it went, or what was wrong.

    Each task writes into a folder of its attempt, and its rows, which name these files, are kept in the shared folder by Spark's own commit: those of lost and repeated attempts are never among them. Then
    executors move the files that rows name into place, which may be repeated too, and the folder of attempts goes. So books appear whole and once, and no list of them comes to the driver.

    With the option ``raise_exceptions`` (on, unless it is set to False) an error of any book ends the write before any book is put in place; without it such books are rows with their error, and the others are written.
    """
    from uuid import uuid4

    o = dict(options or {})
    strict = o.pop("raise_exceptions", True)
    fs, folder, _ = file_system(path)
    attempts = f"{folder}/_attempts-{uuid4().hex}"
    books = corpus.books.join(file_names(corpus), "book")  # names meet the rows of books, not containers
    work = WRITTEN + ", at string"
    kind = _arrow(work)

    def build_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, _ = file_system(path)
        own = f"{attempts}/{uuid4().hex}"
        rows, n = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                r = _plain(batch.slice(k, 1).to_pylist()[0])
                book, file, refused = r["book"], r.pop("file"), r.pop("refused")
                try:
                    if refused:
                        raise ValueError(refused)
                    data = build(r, o)
                    fs.create_dir(own, recursive=True)
                    with fs.open_output_stream(at := f"{own}/{n}") as f:
                        f.write(data)
                    rows.append((book, file, len(data), None, None, at))
                except Exception as e:
                    rows.append((book, file, None, -1, str(e) or type(e).__name__, None))
                n += 1
            yield _rows(rows, kind)
            rows = []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, _ = file_system(path)
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if at:
                    _moved(fs, at, f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        told = written(nested(replace(corpus, books=books)).mapInArrow(build_all, work), "books")
        if strict and (wrong := told.where("error IS NOT NULL").select("book", "error").orderBy("book").limit(5).collect()):
            raise ValueError("books can't be written: " + "; ".join(f"{r['book']}: {r['error']}" for r in wrong))
        told.mapInArrow(place, "n long").agg(F.sum("n")).collect()
    finally:
        if fs.get_file_info(attempts).type == pafs.FileType.Directory:
            fs.delete_dir(attempts)
    return told.drop("at")


def _rows(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)


def write_corpus(corpus: Corpus, path: str, options: dict | None = None) -> int:
    """``write_books``, returning how many were written."""
    return write_books(corpus, path, options).where("error IS NULL").count()


def unpack(packed: DataFrame, path: str) -> int:
    """Write containers (book, data) as folders of files below ``path``, as unpacked books are; returns how many files. Entries that lead out of their folder are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder, _ = file_system(path)
        done = 0
        for batch in batches:
            for book, data in zip(batch.column(0), batch.column(1), strict=True):
                top = f"{folder}/{file_name(book.as_py()).removesuffix('.epub')}"
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for entry in z.namelist():
                        to = posixpath.normpath(f"{top}/{entry}")
                        if not to.startswith(f"{top}/"):
                            raise OSError(f"{entry!r} escapes the book's folder")
                        fs.create_dir(posixpath.dirname(to), recursive=True)
                        with fs.open_output_stream(to) as f:
                            f.write(z.read(entry))
                        done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return packed.select("book", "data").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


__all__ = ["OPTIONS", "build", "entry_time", "file_names", "guide_entries", "markup", "modified", "navigation", "ncx", "nested", "pack", "package", "relative", "unpack", "write_books", "write_corpus"]
