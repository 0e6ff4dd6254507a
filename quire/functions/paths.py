"""POSIX paths and URL escapes as column expressions, inside whole-stage plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(path: Column | str) -> Column:
    """The components of a path, with ``.`` and empty ones left out and ``..`` resolved where it can be."""
    p = _c(path)
    rooted = p.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & ~F.element_at(F.concat(F.array(F.lit("..")), acc), -1).eqNullSafe(F.lit(".."))
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & rooted & (F.size(acc) == 0), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)


def normpath(path: Column | str) -> Column:
    """``posixpath.normpath``."""
    p = _c(path)
    lead = F.when(p.startswith("//") & ~p.startswith("///"), "//").when(p.startswith("/"), "/").otherwise("")
    out = F.concat(lead, F.array_join(parts(p), "/"))
    return F.when(out == "", ".").otherwise(out)


def join(base: Column | str, path: Column | str) -> Column:
    """``posixpath.join``."""
    a, b = _c(base), _c(path)
    return F.when(b.startswith("/") | (a == ""), b).when(a.endswith("/"), F.concat(a, b)).otherwise(F.concat(a, F.lit("/"), b))


def dirname(path: Column | str) -> Column:
    """``posixpath.dirname``."""
    head = F.regexp_extract(_c(path), "^(.*/)[^/]*$", 1)
    return F.when(F.regexp_like(head, F.lit("^/*$")), head).otherwise(F.regexp_replace(head, "/+$", ""))


def relpath(target: Column | str, start: Column | str) -> Column:
    """``posixpath.relpath`` of two paths that are both relative or both absolute."""
    t, s = parts(target), parts(F.when(_c(start) == "", ".").otherwise(_c(start)))
    equal = F.zip_with(t, s, lambda a, b: F.coalesce(a == b, F.lit(False)))
    same = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal)).cast("int")
    # A one-element array binds the common length to a variable.
    out = F.get(F.transform(F.array(same), lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(s) - n), F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0)))), "/")), F.lit(0))
    return F.when(out == "", ".").otherwise(out)


def extension(path: Column | str) -> Column:
    """The lower-case extension as ``posixpath.splitext`` finds it."""
    return F.lower(F.regexp_extract(_c(path), r"[^/.][^/]*?(\.[^./]*)$", 1))


def url_decode(href: Column | str) -> Column:
    """Percent escapes decoded, ``+`` kept; a value with a malformed escape stays as it is."""
    h = _c(href)
    return F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)


def has_scheme(href: Column | str) -> Column:
    return F.regexp_like(_c(href), F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))


def resolve(base: Column | str, href: Column | str) -> Column:
    """A link of a document in the folder ``base``, normalised; links with a scheme stay as they are."""
    return F.when(has_scheme(href), _c(href)).otherwise(normpath(join(base, href)))
