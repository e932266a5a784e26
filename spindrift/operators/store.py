"""Insert-if-absent into the link table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spindrift.operators.dims import absent, assign_ids, next_id

URL_KEY = ["path", "domain_id", "scheme_id"]


def new_urls(url: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """The rows that the link table lacks: distinct (path, domain, scheme) triples with new ids."""
    missing = absent(links.select(*URL_KEY).distinct(), url, URL_KEY, few)
    return assign_ids(missing, URL_KEY, next_id(url)).select(*url.columns)


def insert_urls(url: DataFrame, links: DataFrame) -> DataFrame:
    """The link table grown by the triples it lacks."""
    return url.unionByName(new_urls(url, links))
