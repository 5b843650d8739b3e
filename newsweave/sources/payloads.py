"""Load already fetched payloads by the kind of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.sources import feeds, pages


def load_items(sources: DataFrame, payloads: DataFrame, now: Column, **patterns) -> tuple[DataFrame, DataFrame]:
    """(items, errors) for sources (source_id, kind, url, language) and payloads (url, body).

    `rss` reads the feed, `web` reads the page, `discovery` reads the first readable feed its page advertises and
    never the page itself."""
    fetched = sources.join(payloads, "url", "left")
    missing = fetched.where("body is null").select("source_id", F.lit("not_fetched").alias("error"))
    have = fetched.where("body is not null")

    rss = have.where("kind = 'rss'").withColumnRenamed("body", "xml").select("source_id", "url", "language", "xml")
    page = pages.extract_pages(have.where("kind = 'web'").withColumnRenamed("body", "html").select("source_id", "url", "language", "html"),
                               now, F.col("language"))
    advertised = pages.discovered_links(have.where("kind = 'discovery'").withColumnRenamed("body", "html").select(
        "source_id", "url", "language", "html"), **patterns)
    tried = feeds.parse_feeds(advertised.select("source_id", "language", "pos", F.col("link").alias("url")).join(
        payloads.withColumnRenamed("body", "xml"), "url"))
    readable = tried.where("rejection is null").groupBy("source_id").agg(
        F.min_by(F.struct("url", "language", "xml"), "pos").alias("p")).select("source_id", "p.*")

    wanted = ["source_id", "url", "title", "text", "published_at", "language", "scope"]
    found_feeds = feeds.feed_items(rss.unionByName(readable), now)
    items = found_feeds.select(*wanted).unionByName(pages.accepted(page).select(*wanted))

    bad_rss = feeds.parse_feeds(rss).where("rejection is not null").select("source_id", F.col("rejection").alias("error"))
    bad_page = page.where("rejection is not null").select("source_id", F.col("rejection").alias("error"))
    no_feed = have.where("kind = 'discovery'").select("source_id").join(readable.select("source_id"), "source_id", "left_anti").withColumn(
        "error", F.lit("no_readable_feed"))
    return items, missing.unionByName(bad_rss).unionByName(bad_page).unionByName(no_feed)
