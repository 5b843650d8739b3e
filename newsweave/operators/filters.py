"""Filters of the timeline, the source directory, the watch-list, schedules and backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.operators import matching
from newsweave.operators.ranking import newest


def _contains(needle: str, *columns: Column | str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(needle)))


def within_days(published: Column, days: int, now: Column) -> Column:
    """Dated rows of the last `days` days; every row when days = 0."""
    return (published >= now - F.expr(f"INTERVAL {days} DAY")) if days else F.lit(True)


def project_public(articles: DataFrame) -> DataFrame:
    """Articles without their vectors, so that a columnar scan never reads them."""
    return articles.drop("embedding")


def timeline(articles: DataFrame, company_id: str | None = None, tone: str | None = None, language: str | None = None,
             search: str = "", days: int = 0, now: Column | None = None) -> DataFrame:
    out = articles
    if company_id is not None:
        out = out.where(F.col("company_id") == company_id)
    if tone:
        out = out.where(F.col("analysis.sentiment") == tone)
    if language:
        out = out.where(F.col("language") == language)
    if search:
        out = out.where(_contains(search, "title", "text", "analysis.translated_title", "source_name"))
    return out.where(within_days(F.col("published_at"), days, now)) if days else out


def source_directory(sources: DataFrame, zone: str | None = None, region: str | None = None, language: str | None = None,
                     health: str = "all", search: str = "") -> DataFrame:
    """Sources by zone, region, language, health and text.  Health is all, paused, enabled or a status."""
    out = sources.withColumn("zone", matching.zone_of(F.col("region"))).withColumn(
        "publisher", matching.source_publisher(F.col("publisher"), F.col("url")))
    if zone:
        out = out.where(F.col("zone") == zone)
    if region:
        out = out.where(F.col("region") == region)
    if language:
        out = out.where(F.col("language") == language)
    if health == "paused":
        out = out.where(~F.col("enabled"))
    elif health == "enabled":
        out = out.where("enabled")
    elif health != "all":
        out = out.where(F.col("status") == health)
    return out.where(_contains(search, "name", "region", "publisher", "url")) if search else out


def page_of(df: DataFrame, order: list[Column], page: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """One page; a page beyond the end is clamped to the last one."""
    last = max(-(-df.count() // size) - 1, 0)
    return df.orderBy(*order).offset(min(max(page, 0), last) * size).limit(size)


def watchlist_search(companies: DataFrame, search: str) -> DataFrame:
    return companies.where(~F.col("demo")).where(_contains(search, "name", F.array_join("aliases", " ")))


def due_sources(sources: DataFrame, now: Column, seed: DataFrame | None = None, hours: int = K.COLLECTION_HOURS) -> DataFrame:
    """Enabled sources never fetched or fetched at least `hours` ago, never/oldest first.  With `seed`, only
    sources that are not part of it."""
    out = sources.where(F.col("enabled") & (F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") <= now - F.expr(f"INTERVAL {hours} HOUR"))))
    if seed is not None:
        out = out.join(seed.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return out.orderBy(F.col("last_fetched_at").asc_nulls_first(), "source_id")


def enrich_backlog(articles: DataFrame, failures: DataFrame, model: str | None = None, limit: int | None = None,
                   max_failures: int = K.ENRICH_MAX_FAILURES) -> DataFrame:
    """Articles still to be enriched, newest fetched first, without those that failed too often.  With `model`,
    vectors of another model are pending too."""
    pending = (F.col("analysis.mode") != "model") | F.col("embedding").isNull()
    if model is not None:
        pending = pending | ~F.coalesce(F.col("embedding_model") == model, F.lit(False))
    out = articles.where(pending & ~F.col("demo")).join(failures.select("article_id", "failures"), "article_id", "left").where(
        F.coalesce("failures", F.lit(0)) < max_failures).orderBy(F.col("fetched_at").desc(), "article_id")
    return out.limit(limit) if limit else out


def latest_articles(articles: DataFrame, company_id: str, limit: int) -> DataFrame:
    time = F.coalesce("published_at", "fetched_at")
    return articles.where(F.col("company_id") == company_id).orderBy(newest(time), "article_id").limit(limit)
