"""Web pages to article items, and feed discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import html, text, url


def extract_pages(pages: DataFrame, now: Column, language: Column | None = None, title_chars: int | None = None,
                  text_chars: int | None = None) -> DataFrame:
    """Title, body, date and language of each page (url, html) with a reject reason; null means accepted.
    Whole texts are kept unless a limit is given."""
    language = F.lit("en") if language is None else language
    source, meta = F.col("html"), F.col("_meta")
    rows = pages.withColumn("_meta", html.meta_tags(source)).withColumns({
        "title": html.page_title(source, meta), "text": html.page_body(source, meta), "published_at": html.page_date(source, now, meta)})
    if title_chars:
        rows = rows.withColumn("title", F.substring("title", 1, title_chars))
    if text_chars:
        rows = rows.withColumn("text", F.substring("text", 1, text_chars))
    return (
        rows.withColumns({"url": url.canonical_url(F.col("url")), "language": text.detect_language(F.col("text"), language)})
        .withColumn("rejection", F.when(F.col("url").isNull(), "bad_url").otherwise(html.page_rejection(F.col("title"), F.col("text"))))
        .drop("html", "_meta")
    )


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.where("rejection is null").drop("rejection").withColumn("scope", F.lit("article"))


def discovered_links(pages: DataFrame, **patterns) -> DataFrame:
    """Advertised addresses of each page with their order (1-based)."""
    links = html.advertised_links(F.col("html"), F.col("url"), **patterns)
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(links).alias("pos", "link")).withColumn(
        "pos", F.col("pos") + 1)
