"""Extract, resolve and normalize the links of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions.urls import (
    COMPONENTS,
    SUPPORTED_SCHEMES,
    authority_host,
    directory_name,
    host_of,
    raw_parts,
    raw_struct,
    remove_dot_segments,
    scheme_of,
    unmarked,
    unset,
)

# Fixed value: the link pattern.  ``d`` makes ``.`` stop at a newline only.
HREF = r"""(?id)<a.+?href=("|')(?!javascript:|#)(.+?)("|')"""


# What of a line the pattern can still match: up to the closing quote of its last link value.
LINKED = r"""(?id)^(.*href=("|')(?!javascript:|#).+?("|'))"""


def hrefs(html: Column) -> Column:
    """All link values of a page in document order, duplicates kept.

    The pattern never reaches over a line's end.  Lines are cut behind their
    last link value first, so that no opening tag is left to be tried against
    the rest of its line in vain; time then grows with the text only.
    """
    linked = F.transform(F.split(html, "\n", -1), lambda line: F.regexp_extract(line, LINKED, 1))
    found = F.transform(F.filter(linked, lambda line: line != ""), lambda line: F.regexp_extract_all(line, F.lit(HREF), 2))
    return F.flatten(found)


def extract_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """One row per link, with the page columns in ``keep``; the page text is left behind at once."""
    return pages.select("page_id", "url", *keep, F.posexplode(hrefs(F.col(html))).alias("pos", "href"))


def resolve_links(links: DataFrame, mode: str = "rfc") -> DataFrame:
    """Add ``resolved``, the link made absolute against its page's URL.

    ``rfc`` follows RFC 3986 section 5.2, link by link.  ``legacy`` keeps the
    state that runs along the links of one page, as described there.
    """
    if mode == "rfc":
        return _resolve_rfc(links.withColumn("_base", raw_struct(F.col("url")))).drop("_base", "_target")
    if mode == "legacy":
        return _resolve_legacy(links)
    raise ValueError(f"unknown mode {mode!r}")


def _resolve_rfc(links: DataFrame) -> DataFrame:
    """Add ``_target``, the parts of the absolute link, and ``resolved``, their text.

    ``links`` holds ``_base``, the parts of the page's URL.  Each step is a
    column of its own, so that no part is worked out twice.
    """
    base, ref, target = F.col("_base"), F.col("_ref"), F.col("_target")
    has_scheme = ref["scheme"] != ""
    has_path = ref["path"] != ""
    has_own_host = has_scheme | (ref["authority"] != "")
    directory = F.regexp_extract(base["path"], r"(?s)^(.*/)", 1)
    path = (
        F.when(has_own_host | F.startswith(ref["path"], F.lit("/")), ref["path"])
        .when(has_path, F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), ref["path"]))
        .otherwise(base["path"])
    )
    parts = F.struct(
        F.when(has_scheme, ref["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(has_own_host, ref["authority"]).otherwise(base["authority"]).alias("authority"),
        remove_dot_segments(F.col("_path")).alias("path"),
        F.when(has_own_host | has_path | (ref["query"] != ""), ref["query"]).otherwise(base["query"]).alias("query"),
        ref["fragment"].alias("fragment"),
    )
    return (
        links.withColumn("_ref", raw_struct(F.col("href")))
        .withColumn("_path", path)
        .withColumn("_target", parts)
        .withColumn("resolved", F.concat(*[target[name] for name in COMPONENTS]))
        .drop("_ref", "_path")
    )


def _resolve_legacy(links: DataFrame) -> DataFrame:
    """Resolution whose climbs add up along a page and whose odd links repeat the one before.

    A window by page holds the links of one page row only.
    """
    href, url = F.col("href"), F.col("url")
    base = raw_parts(url)
    along = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    climbs = F.startswith(href, F.lit(".."))
    steps = F.sum(F.when(climbs, F.regexp_count(href, F.lit(r"\.\./"))).otherwise(0)).over(along)

    directory = directory_name(url)
    levels = F.split(directory, "/", -1)
    left = F.slice(levels, F.lit(1), F.greatest(F.size(levels) - F.col("_steps"), F.lit(0)).cast("int"))
    own = (
        F.when(climbs, F.concat(F.array_join(left, "/"), F.lit("/"), F.replace(href, F.lit("../"), F.lit(""))))
        .when(F.startswith(href, F.lit("//")), F.concat(base["scheme"], href))
        .when(
            href.rlike(r"(?d)^.?/"),
            F.concat(base["scheme"], F.lit("//"), authority_host(base["authority"]), href),
        )
        .when(F.startswith(href, F.lit("http")), href)
        .when(href.rlike("^[a-zA-Z0-9]"), F.concat(directory, F.lit("/"), href))
    )
    return (
        links.withColumn("_steps", steps)
        .withColumn("_own", own)
        .withColumn("resolved", F.coalesce(F.last("_own", ignorenulls=True).over(along), F.lit("")))
        .drop("_steps", "_own")
    )


def normalize_links(resolved: DataFrame) -> DataFrame:
    """Add the parts of ``resolved``, with the page's host and scheme and ``/`` for what is missing."""
    parts = {"_base": F.col("url"), "_target": F.col("resolved")}
    missing = {name: raw_struct(url) for name, url in parts.items() if name not in resolved.columns}
    base, target = F.col("_base"), F.col("_target")
    return (
        resolved.withColumns(missing)
        .withColumns(
            {
                "scheme": F.coalesce(scheme_of(target["scheme"]), scheme_of(base["scheme"])),
                "host": F.coalesce(host_of(target["authority"]), host_of(base["authority"])),
                "path": F.coalesce(unset(target["path"]), F.lit("/")),
                "query": unmarked(target["query"]),
                "fragment": unmarked(target["fragment"]),
            }
        )
        .withColumn("scheme_supported", F.col("scheme").isin(*SUPPORTED_SCHEMES))
        .drop("_base", "_target")
    )


def page_links(
    pages: DataFrame, mode: str = "rfc", html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """Pages to normalized links: extraction, resolution and defaults in one pass.

    The page's own URL is taken apart once per page, and a link once.
    """
    based = pages.withColumn("_base", raw_struct(F.col("url")))
    return link_parts(extract_links(based, html, ["_base", *keep]), mode)


def link_parts(links: DataFrame, mode: str = "rfc") -> DataFrame:
    """Extracted links to normalized links."""
    if mode == "rfc":
        based = links if "_base" in links.columns else links.withColumn("_base", raw_struct(F.col("url")))
        return normalize_links(_resolve_rfc(based))
    return normalize_links(resolve_links(links, mode))
