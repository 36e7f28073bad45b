"""URL, host and response-header expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted schemes, status codes that are followed (308 is not).
ACCEPTED_SCHEMES = ("http", "https")
REDIRECT_CODES = (301, 302, 303, 307)

# RFC 3986, appendix B: scheme, //authority, path, ?query, #fragment.
_PARTS = r"^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_ASCII = r"^[\x00-\x7F]*$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def accepted_scheme(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:" + "|".join(ACCEPTED_SCHEMES) + "):"), F.lit(False))


def scheme_error(url: Column) -> Column:
    """NULL for an accepted URL, else the text of the rejection."""
    text = F.format_string("Unknown scheme '%s' in '%s'", scheme(url), url)
    return F.when(url.isNull(), F.lit("Unknown scheme")).when(~accepted_scheme(url), text)


def host_key(url: Column) -> Column:
    """Lower-cased authority. A port or user-info stays, so it prevents a match."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def idn_ascii(host: Column) -> Column:
    """Punycode form of a host, NULL where it has none.

    ASCII hosts pass unchanged; the others use the IDNA 2003 conversion of the
    JDK, one static call per non-ASCII host.
    """
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike(_ASCII), host).otherwise(encoded)


def idn_url(url: Column) -> Column:
    """URL with its authority in punycode form, the rest untouched."""
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    before = F.regexp_extract(url, r"^([^:/?#]+://)", 1)
    after = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([\s\S]*)$", 1)
    return F.when(authority.rlike(_ASCII), url).otherwise(
        F.concat(before, idn_ascii(authority), after)
    )


def status_class(code: Column) -> Column:
    return F.floor(code / 100).cast("int")


def is_redirect(code: Column) -> Column:
    return F.coalesce(code.isin(*REDIRECT_CODES), F.lit(False))


def last_location(headers: Column) -> Column:
    """Value of the last Location header; NULL when absent or empty."""
    values = F.regexp_extract_all(headers, F.lit(r"(?im)^location: (.*?)\r\n"), F.lit(1))
    return F.nullif(F.try_element_at(values, F.lit(-1)), F.lit(""))


def _without_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; those above the root fall away."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(s == "..", acc)
        .otherwise(F.array_append(acc, s)),
    )
    last_is_dots = F.element_at(segments, -1).isin(".", "..")
    closed = F.when(last_is_dots, F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.array_join(closed, "/")


def _strip_leading_dots(url: Column) -> Column:
    """Leading ``/.`` and ``/..`` path segments removed, at least ``/`` left."""
    inner = F.regexp_replace(url, r"^([^:/?#]+://[^/?#]*)(?:/\.{1,2})+/", "$1/")
    return F.regexp_replace(inner, r"^([^:/?#]+://[^/?#]*)(?:/\.{1,2})+(?=[?#]|$)", "$1/")


def absolutize(base: Column, ref: Column) -> Column:
    """``ref`` resolved against ``base`` as in RFC 3986.

    A reference that is absolute, or names an absolute path, keeps its inner
    dot segments; only leading ones are stripped.
    """
    same_scheme = scheme(ref) == scheme(base)
    bare_same = same_scheme & (_part(ref, 2) == "")
    relative = F.when(bare_same, F.regexp_replace(ref, r"^[^:/?#]+:", "")).otherwise(ref)
    absolute = (_part(ref, 1) != "") & ~bare_same

    base_authority, base_path = _part(base, 2), _part(base, 3)
    path, query, fragment = _part(relative, 3), _part(relative, 4), _part(relative, 5)
    root = F.concat(_part(base, 1), F.lit(":"), base_authority)
    folder = F.when((base_authority != "") & (base_path == ""), F.lit("/")).otherwise(
        F.regexp_extract(base_path, r"^(.*/)", 1)
    )
    resolved = (
        F.when(_part(relative, 2) != "", F.concat(_part(base, 1), F.lit(":"), relative))
        .when(
            path == "",
            F.concat(
                root,
                base_path,
                F.when(query == "", _part(base, 4)).otherwise(query),
                fragment,
            ),
        )
        .when(path.startswith("/"), F.concat(root, relative))
        .otherwise(
            F.concat(root, _without_dot_segments(F.concat(folder, path)), query, fragment)
        )
    )
    return _strip_leading_dots(F.when(absolute, ref).otherwise(resolved))
