"""Sitemaps from documents at hand: urls of url sets, and of indexes down to a depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locations(xml: Column) -> Column:
    """The trimmed contents of all ``loc`` elements, references to ``&`` decoded."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda u: F.regexp_replace(u, "&amp;", "&"))


def sitemap_urls(documents: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Distinct page urls of the sitemaps reachable from ``starts`` (url) among ``documents`` (url, xml).

    An index refers to further sitemaps, followed to ``depth`` levels by one join each; a document
    that isn't there has no urls.
    """
    level, out = starts.select("url").distinct(), None
    for _ in range(depth):
        here = level.join(documents, "url").select(F.explode(locations(F.col("xml"))).alias("url"), F.lower("xml").contains("<sitemapindex").alias("is_index"))
        pages = here.where("not is_index").select("url")
        out = pages if out is None else out.unionByName(pages)
        level = here.where("is_index").select("url").distinct()
    return out.distinct()
