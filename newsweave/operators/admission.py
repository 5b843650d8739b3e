"""Admission rules: quotas, excerpts, paged documents, snapshot entries, calendar tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import dates, url
from newsweave.operators.matching import entity_match
from newsweave.operators.ranking import join_on_keys, within_quota


def quota_admission(events: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group are admitted, the rest deferred."""
    return within_quota(events, group, order, limit).withColumn("outcome", F.when(F.col("admitted"), "admitted").otherwise("deferred")).drop("admitted")


def run_quota(rows: DataFrame, stored: DataFrame, keys: list[str], group: list[str], order: list[Column], limit: int) -> DataFrame:
    """Outcome of each row of a run: rows stored already are duplicates and use no quota; of the others, the first `limit` of each group are
    admitted and the rest deferred."""
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = join_on_keys(rows, known, keys, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    fresh = quota_admission(marked.where(~F.col("_known")).drop("_known"), group, order, limit)
    return fresh.unionByName(marked.where("_known").drop("_known").withColumn("outcome", F.lit("duplicate")))


def date_tiles(ranges: DataFrame, start: str = "from_day", end: str = "to_day", days: int = K.TILE_DAYS) -> DataFrame:
    """Consecutive windows of `days` days covering each range; the last one is clipped."""
    step = F.expr(f"INTERVAL {days} DAY")
    return (
        ranges.withColumn("tile_start", F.explode(F.sequence(start, end, step)))
        .withColumn("tile_end", F.least(F.date_add("tile_start", days - 1), F.col(end)))
        .withColumn("tile_no", (F.datediff("tile_start", start) / days).cast("int"))
        .withColumn("tiles", F.ceil((F.datediff(end, start) + 1) / days).cast("int"))
    )


def excerpt_import(rows: DataFrame, companies: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each user-supplied excerpt (row_id, company_id, title, text, url)."""
    named = entity_match(rows, companies, key="row_id", scope="company_id").withColumn("named", F.lit(True))
    keyed = rows.withColumn("canonical", url.canonical_url(F.col("url")))
    stored = existing.select("company_id", F.col("url").alias("canonical")).distinct().withColumn("stored", F.lit(True))
    # repeats inside the batch: only the first row of a (company, url) can be imported
    first = keyed.groupBy("company_id", "canonical").agg(F.min("row_id").alias("row_id")).withColumn("first", F.lit(True))
    outcome = (
        F.when(url.url_rejection(F.col("url")).isNotNull(), "bad_url")
        .when(F.col("stored"), "duplicate")
        .when(F.coalesce(F.length("title"), F.lit(0)) == 0, "missing_title")
        .when(F.coalesce(F.length("text"), F.lit(0)) < K.MIN_PAGE_CHARS, "too_short")
        .when(F.col("named").isNull(), "entity_not_named")
        .when(F.col("first").isNull(), "duplicate")
        .otherwise("imported")
    )
    return (
        keyed.join(named, ["row_id", "company_id"], "left").join(stored, ["company_id", "canonical"], "left")
        .join(first, ["company_id", "canonical", "row_id"], "left")
        .withColumn("outcome", outcome)
        .withColumn("content_scope", F.when(F.col("outcome") == "imported", "manual"))
        .drop("named", "stored", "first")
    )


def page_admission(pages: DataFrame, companies: DataFrame, ocr: bool = False) -> DataFrame:
    """Route document pages (doc_id, company_id, page_no, text, reviewed, ocr_text): scanned pages wait for review
    or are unreadable; reviewed pages need enough text and a named company."""
    scanned = F.length("text") < K.MIN_SCAN_CHARS
    method = F.when(~scanned, "pdf-text").when(F.lit(ocr), "vision-ocr").otherwise("unreadable")
    body = F.when(F.col("method") == "vision-ocr", F.col("ocr_text")).otherwise(F.col("text"))
    routed = pages.withColumn("method", method).withColumn("body", body).withColumn(
        "is_reviewed", (F.col("method") == "pdf-text") | F.coalesce("reviewed", F.lit(False)))
    keyed = routed.withColumn("page_key", F.struct("doc_id", "page_no"))
    named = entity_match(keyed, companies, key="page_key", body=F.col("body"), scope="company_id").select(
        "page_key", "company_id", F.lit(True).alias("named"))
    outcome = (
        F.when(~F.col("is_reviewed") & (F.col("method") == "unreadable"), "unreadable")
        .when(~F.col("is_reviewed"), "awaiting_review")
        .when(F.length("body") < K.MIN_PAGE_CHARS, "too_short")
        .when(F.col("named").isNull(), "entity_not_named")
        .otherwise("imported")
    )
    return keyed.join(named, ["page_key", "company_id"], "left").withColumn("outcome", outcome).withColumn(
        "content_scope", F.when(F.col("outcome") == "imported", F.when(F.col("method") == "vision-ocr", "pdf-ocr").otherwise("pdf-text"))
    ).drop("page_key", "named")


def document_status(admitted: DataFrame) -> DataFrame:
    """Status of each document from its pages."""
    return admitted.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.when(F.col("outcome") == "imported", 1).otherwise(0)).alias("articles"),
        F.when(F.bool_and("is_reviewed"), "completed").otherwise("review").alias("status"),
    )


def snapshot_admit(entries: DataFrame, sources: DataFrame, companies: DataFrame, seed_sources: DataFrame, seed_companies: DataFrame) -> DataFrame:
    """Snapshot entries (entry_id, company_id, source_id, title, text, url) that may be imported: enabled known
    source that is in the public seed under the same address, known public company, public address, and the
    company is named again."""
    public_sources = sources.where("enabled").join(seed_sources.select("source_id", "url"), ["source_id", "url"], "left_semi").select("source_id")
    public_companies = companies.join(seed_companies.select("company_id"), "company_id", "left_semi")
    known = (
        entries.where(url.is_public_url(F.col("url")))
        .join(public_sources, "source_id", "left_semi")
        .join(public_companies.select("company_id"), "company_id", "left_semi")
    )
    named = entity_match(known, public_companies, key="entry_id", scope="company_id")
    return known.join(named, ["entry_id", "company_id"], "left_semi")


def date_eligibility(items: DataFrame, start: Column, end: Column) -> DataFrame:
    return items.withColumn("eligibility", dates.date_eligibility(F.col("published_at"), start, end))
