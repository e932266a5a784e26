"""Column expressions on URLs.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI expression of RFC 3986, appendix B, with the
# scheme held to its own grammar; and the host and port within an authority.
URI = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"
AUTHORITY_HOST = r"^//(?:.*@)?(\[[^\]]*\]|[^:@]*)(?::\d*)?$"
AUTHORITY_PORT = r":(\d+)$"

MAX_LENGTH = 2**31 - 1

SUPPORTED_SCHEMES = ("http", "https")


COMPONENTS = ("scheme", "authority", "path", "query", "fragment")


def unset(col: Column) -> Column:
    return F.when(col != "", col)


def raw_parts(url: Column) -> dict[str, Column]:
    """The five components with the marks that set them apart; ``''`` where missing.

    Put together in order they give the URL back.
    """
    return {name: F.regexp_extract(url, URI, i) for i, name in enumerate(COMPONENTS, 1)}


def raw_struct(url: Column) -> Column:
    return F.struct(*[part.alias(name) for name, part in raw_parts(url).items()])


def scheme_of(marked: Column) -> Column:
    """Scheme in lower case from one with its colon."""
    return unset(F.lower(F.rtrim(marked, F.lit(":"))))


def authority_host(authority: Column) -> Column:
    return F.regexp_extract(authority, AUTHORITY_HOST, 1)


def host_of(authority: Column) -> Column:
    """Host in lower case, without user and port, from an authority with its slashes."""
    return unset(F.lower(authority_host(authority)))


def unmarked(part: Column) -> Column:
    """A query or fragment without its mark."""
    return unset(F.substring(part, 2, MAX_LENGTH))


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, port, path, query and fragment; NULL where missing.

    Scheme and host are in lower case; the host holds neither user nor port.
    """
    raw = raw_parts(url)
    return F.struct(
        scheme_of(raw["scheme"]).alias("scheme"),
        host_of(raw["authority"]).alias("host"),
        unset(F.regexp_extract(raw["authority"], AUTHORITY_PORT, 1)).try_cast("int").alias("port"),
        unset(raw["path"]).alias("path"),
        unmarked(raw["query"]).alias("query"),
        unmarked(raw["fragment"]).alias("fragment"),
    )


def url_host(url: Column) -> Column:
    return host_of(F.regexp_extract(url, URI, 2))


def page_url(scheme: Column, host: Column, path: Column) -> Column:
    return F.concat(scheme, F.lit("://"), host, path)


def content_key(parts: Column, is_html: Column) -> Column:
    """Address of stored content: hash of host and path, then the query for HTML only.

    The query is written in form encoding with ``*`` escaped too.
    """
    query = F.replace(F.url_encode(F.coalesce(parts["query"], F.lit(""))), F.lit("*"), F.lit("%2A"))
    base = F.md5(F.concat(parts["host"], F.coalesce(parts["path"], F.lit(""))))
    return F.concat(base, F.when(is_html, query).otherwise(F.lit("")))


def remove_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` taken out of an absolute path (RFC 3986, section 5.2.4).

    Only paths that hold a dot segment pay for the walk over their segments.
    """
    segments = F.split(path, "/", -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    cleaned = F.array_join(F.when(ends_in_dots, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/")
    return F.when(F.contains(path, F.lit("/.")), cleaned).otherwise(path)


def directory_name(url: Column) -> Column:
    """Everything before the last name of a slash-separated string, trailing slashes aside."""
    return F.when(F.contains(url, F.lit("/")), F.regexp_replace(url, r"/+[^/]*/*\z", "")).otherwise(F.lit("."))
