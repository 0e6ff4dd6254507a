"""Classification and attributes of items as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .paths import _c, extension


def choose(value: Column, table: Mapping, default: object = None) -> Column:
    """A CASE over a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


_TYPE_BY_EXTENSION = {e: t for t in reversed(C.EXTENSIONS) for e in C.EXTENSIONS[t]}
_TYPE_BY_KIND = {"html": C.DOCUMENT, "cover_html": C.DOCUMENT, "nav": C.DOCUMENT, "image": C.IMAGE, "cover": C.COVER, "smil": C.SMIL}


def type_by_extension(file_name: Column | str) -> Column:
    """The item type of a file name; 0 where no list has its extension. Images come before covers, so no plain item is a cover."""
    return choose(extension(file_name), _TYPE_BY_EXTENSION, C.UNKNOWN).cast("int")


def item_type(kind: Column | str, file_name: Column | str) -> Column:
    """The type of an item: by its kind where the kind has one, else by extension."""
    return F.coalesce(choose(_c(kind), _TYPE_BY_KIND), type_by_extension(file_name)).cast("int")


def encoding(file_name: Column | str) -> Column:
    return choose(extension(file_name), C.ENCODINGS)


def guess_media_type(file_name: Column | str) -> Column:
    """The media type by the extension (under a compression's, by the one before it); null where it isn't known."""
    name = _c(file_name)
    inner = F.regexp_replace(name, r"(?i)\.(gz|bz2|xz|z)$", "")
    return choose(extension(inner), C.MEDIA_TYPES)


def media_type_default(media_type: Column | str, file_name: Column | str, encoding_wins: bool = False) -> Column:
    """A given media type, else the guessed one, else octet-stream. ``encoding_wins`` puts a compression's name in place of the type."""
    guess = F.coalesce(guess_media_type(file_name), F.lit(C.DEFAULT_MEDIA_TYPE))
    if encoding_wins:
        guess = F.coalesce(encoding(file_name), guess)
    return F.when(_c(media_type) != "", _c(media_type)).otherwise(guess)


def manifest_media_type(media_type: Column | str) -> Column:
    return F.when(_c(media_type) == "image/jpg", "image/jpeg").otherwise(_c(media_type))


def manifest_kind(media_type: Column | str, properties: Column | str) -> Column:
    """The kind of a manifest entry from its media type and its properties (an array)."""
    m, p = _c(media_type), F.coalesce(_c(properties), F.array().cast("array<string>"))
    has = lambda x: F.array_contains(p, x)
    return (
        F.when(m == C.NCX_TYPE, "ncx").when(m == C.SMIL_TYPE, "smil")
        .when(m == C.XHTML_TYPE, F.when(has("nav"), "nav").when(has("cover"), "cover_html").otherwise("html"))
        .when(m.isin(*C.IMAGE_TYPES), F.when(has("cover-image"), "cover").otherwise("image"))
        .otherwise("item")
    )


def is_chapter(kind: Column | str) -> Column:
    return _c(kind) == "html"


def namespace(ns: Column | str) -> Column:
    """A namespace's URI for its short name; others stay as they are."""
    return F.coalesce(choose(_c(ns), C.NAMESPACES), _c(ns))


def language(lang: Column | str, book_language: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(lang), F.lit("")), _c(book_language))


def landmark_type(guide_type: Column | str) -> Column:
    return F.coalesce(choose(_c(guide_type), C.LANDMARKS), _c(guide_type))


def content(stored: Column | str, default: Column | bytes = b"") -> Column:
    """Stored bytes, else the default, else none."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(stored), F.lit(b"")), d, F.lit(b""))


def modified_utc(ts: Column | str, offset_hours: Column | int = 0) -> Column:
    """A local time at an offset from UTC as the package's modification time."""
    off = offset_hours if isinstance(offset_hours, Column) else F.lit(offset_hours)
    utc = F.timestamp_seconds(F.unix_timestamp(_c(ts).cast("timestamp_ntz").cast("timestamp")) - off * 3600)
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def zip_time(ts: Column | str) -> Column:
    """The six numbers of an archive entry's time; years before 1980 become 1980-01-01."""
    t = F.greatest(_c(ts), F.lit("1980-01-01 00:00:00").cast("timestamp"))
    return F.struct(*[f(t).cast("int").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute), ("second", F.second))])


def prefix(name: Column | str, uri: Column | str) -> Column:
    return F.concat(_c(name), F.lit(": "), _c(uri))


def template(templates: Column | str, name: str) -> Column:
    return F.try_element_at(_c(templates), F.lit(name))
