"""Coverage, run, source and backlog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text
from newsweave.operators.clustering import event_time, story_groups
from newsweave.operators.matching import zone_of
from newsweave.operators.ranking import newest, top_k


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def coverage_by_company(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Stored and model-enriched articles with their date span, companies without coverage included."""
    stats = articles.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("stored"), _count_if(F.col("analysis.mode") == "model").alias("enriched"),
        F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"))
    return companies.select("company_id", "name").join(stats, "company_id", "left").select(
        "company_id", "name", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("enriched", F.lit(0)).alias("enriched"),
        "earliest", "latest").orderBy("name", "company_id")


def coverage_kpis(articles: DataFrame) -> DataFrame:
    """Overview numbers per company, with the newest article's summary."""
    counts = articles.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.countDistinct("cluster_id").alias("stories"),
        F.countDistinct("publisher").alias("publishers"),
        _count_if(~F.col("region").isin("India", "Global")).alias("regional"),
        F.countDistinct("language").alias("languages"),
        _count_if(F.col("analysis.mode") == "baseline").alias("baseline"),
        F.min_by("analysis.summary", F.struct(newest(event_time()), F.col("article_id"))).alias("newest_summary"),
    )
    tones = story_groups(articles).groupBy("company_id").agg((F.countDistinct("analysis.sentiment") > 1).alias("several_tones"))
    return counts.join(tones, "company_id").withColumn("repeats", F.col("articles") - F.col("stories"))


def _with_zero_rows(df: DataFrame, column: str, values: tuple[str, ...], keys: DataFrame) -> DataFrame:
    """Left join counts to keys x values, zero where nothing was counted."""
    grid = keys.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df, [*keys.columns, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tone_by_story(articles: DataFrame) -> DataFrame:
    """Tone of the newest article of each story; all four tones per company, with their share in percent."""
    stories = story_groups(articles)
    counts = stories.groupBy("company_id", F.col("analysis.sentiment").alias("tone")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("company_id").agg(F.sum("n").alias("total"))
    full = _with_zero_rows(counts, "tone", K.TONES, totals.select("company_id"))
    return full.join(totals, "company_id").select("company_id", "tone", "n", (F.col("n") / F.col("total") * 100).alias("share"))


def zone_footprint(articles: DataFrame) -> DataFrame:
    """Articles per zone and company, zero rows included."""
    counts = articles.groupBy("company_id", zone_of(F.col("region")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("company_id").agg(F.sum("n").alias("total"))
    full = _with_zero_rows(counts, "zone", K.ZONES, totals.select("company_id"))
    return full.join(totals, "company_id").select("company_id", "zone", "n", (F.col("n") / F.col("total") * 100).alias("share"))


def zone_tone_pivot(articles: DataFrame) -> DataFrame:
    """Articles (not stories) per zone and tone; zones without articles do not appear."""
    return (
        articles.groupBy(zone_of(F.col("region")).alias("zone"))
        .agg(F.count(F.lit(1)).alias("articles"), *[_count_if(F.col("analysis.sentiment") == t).alias(t) for t in K.TONES])
    )


def run_metrics(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counters per source.  `items`: source_id, item_id; `pairs`: item_id, source_id, company_id, is_new.
    `matched_items` counts items with a match, `matched_pairs` counts (item, company) pairs."""
    scanned = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("scanned"))
    matched = pairs.groupBy("source_id").agg(
        F.countDistinct("item_id").alias("matched_items"), F.count(F.lit(1)).alias("matched_pairs"),
        _count_if(F.col("is_new")).alias("inserted"), _count_if(~F.col("is_new")).alias("duplicates"))
    return scanned.join(matched, "source_id", "left").na.fill(0, ["matched_items", "matched_pairs", "inserted", "duplicates"])


def source_counters(metrics: DataFrame) -> DataFrame:
    """Inserted and duplicate counters as a map per source."""
    return metrics.select("source_id", F.create_map(F.lit("inserted"), "inserted", F.lit("duplicates"), "duplicates").alias("stats"))


def run_status(outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """Status per run from (run_id, error, warning, truncated): error > partial > success.  The distinct warnings of a run are
    joined in order; with `limit`, cut to that many characters (no more than that many warnings can fit)."""
    flags = outcomes.groupBy("run_id").agg(
        F.max(F.when(F.col("error").isNotNull(), 2).when(F.col("warning").isNotNull() | F.coalesce("truncated", F.lit(False)), 1).otherwise(0)).alias("severity"),
        F.min("error").alias("error"))
    distinct = outcomes.where(F.length("warning") > 0).select("run_id", "warning").distinct()
    few = top_k(distinct, ["run_id"], [F.col("warning")], limit) if limit else distinct
    joined = F.array_join(F.array_sort(F.collect_list("warning")), " ")
    listed = few.groupBy("run_id").agg((F.substring(joined, 1, limit) if limit else joined).alias("warnings"))
    status = F.when(F.col("severity") == 2, "error").when(F.col("severity") == 1, "partial").otherwise("success")
    return flags.join(listed, "run_id", "left").select("run_id", status.alias("status"), F.coalesce("error", "warnings").alias("message"))


def source_health(sources: DataFrame) -> DataFrame:
    """Sources per language and status."""
    return sources.groupBy("language").agg(
        F.count(F.lit(1)).alias("sources"),
        *[_count_if(F.col("status") == s).alias(s) for s in ("healthy", "error", "unfetched")],
        _count_if(~F.col("enabled")).alias("paused"),
        _count_if(F.col("region") == "Global").alias("global_sources"),
        F.countDistinct("publisher").alias("publishers"),
    )


def zone_health(sources: DataFrame) -> DataFrame:
    """Sources per zone, empty zones included: how many, how many of the enabled ones are healthy, failed or not fetched yet, and their languages and publishers."""
    zones = sources.sparkSession.createDataFrame([(z,) for z in [*(z for z, _ in K.ZONE_REGIONS), K.DEFAULT_ZONE]], "zone string").distinct()
    live = lambda s: _count_if(F.col("enabled") & (F.col("status") == s)).alias(s)
    counted = sources.withColumn("zone", zone_of(F.col("region"))).groupBy("zone").agg(
        F.count(F.lit(1)).alias("sources"), live("healthy"), live("error"), live("unfetched"), _count_if(~F.col("enabled")).alias("paused"), F.countDistinct("language").alias("languages"), F.countDistinct("publisher").alias("publishers"))
    return zones.join(counted, "zone", "left").na.fill(0)


def error_taxonomy(failures: DataFrame, message: str = "error") -> DataFrame:
    """Failures by category with the suggested action."""
    category = text.classify(F.col(message), K.FAILURE_RULES, K.DEFAULT_FAILURE)
    counts = failures.where(F.length(message) > 0).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    actions = F.create_map(*[F.lit(x) for pair in K.FAILURE_ACTIONS.items() for x in pair])
    return counts.withColumn("action", actions[F.col("category")])


OUTCOMES = ("imported", "duplicates", "failed", "unknownDate", "outsideRange", "unmatched")


def import_outcomes(candidates: DataFrame) -> DataFrame:
    """Counters per import job from (job_id, outcome); a null outcome is still pending."""
    counted = candidates.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("collected"), *[_count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        _count_if(F.col("outcome").isNull()).alias("pending"))
    gaps = F.col("failed") + F.col("unknownDate") + F.col("outsideRange")
    return counted.withColumn("progress", F.floor(100 * (F.col("collected") - F.col("pending")) / F.col("collected")).cast("int")).withColumn(
        "status", F.when(F.col("pending") > 0, "running").when(gaps > 0, "partial").otherwise("completed"))


def coverage_gaps(tiles: DataFrame, found: DataFrame, key: str, cap: int = K.INDEX_RESULT_CAP) -> DataFrame:
    """Windows whose result reached the index cap (incomplete) or is empty (gap).  `found`: key, day.  Rows are
    counted per day first, so only day counts meet the windows."""
    per_day = found.groupBy(key, "day").agg(F.count(F.lit(1)).alias("n"))
    by_day = tiles.withColumn("day", F.explode(F.sequence("tile_start", "tile_end", F.expr("INTERVAL 1 DAY"))))
    counts = by_day.join(per_day, [key, "day"], "left").groupBy(key, "tile_start", "tile_end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("results"))
    return counts.withColumn("flag", F.when(F.col("results") >= cap, "incomplete").when(F.col("results") == 0, "gap").otherwise("ok"))


def backlog_summary(jobs: DataFrame) -> DataFrame:
    """Runnable jobs per kind: how many, and the one that waited longest."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("runnable"), F.min_by("job_id", F.struct("updated_at", "job_id")).alias("next_job"),
        F.min("updated_at").alias("oldest"))


def schedule_status(runs: DataFrame, now: Column, paused: Column | None = None) -> DataFrame:
    """Per source: latest run, next run and state (paused > error > delayed > current)."""
    latest = runs.groupBy("source_id").agg(
        F.max("started_at").alias("last_run_at"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))
    state = (
        F.when(paused if paused is not None else F.lit(False), "paused")
        .when(F.col("last_status") == "error", "error")
        .when(F.col("last_run_at").isNull(), "waiting")
        .when(now - F.expr(f"INTERVAL {K.DELAYED_HOURS} HOUR") > F.col("last_run_at"), "delayed")
        .otherwise("current")
    )
    return latest.select("source_id", "last_run_at", (F.col("last_run_at") + F.expr(f"INTERVAL {K.COLLECTION_HOURS} HOUR")).alias("next_run_at"), state.alias("state"))


def run_gaps(runs: DataFrame, hours: int = K.DELAYED_HOURS) -> DataFrame:
    """Pauses longer than `hours` (at least one) between consecutive runs of a source.  Such a pause lies between the last
    run of one active hour and the first run of the next one, so only one row per source and hour is compared."""
    active = runs.groupBy("source_id", F.date_trunc("hour", "started_at").alias("hour")).agg(
        F.min(F.struct("started_at", "run_id")).alias("first"), F.max("started_at").alias("last"))
    previous = F.lag("last").over(Window.partitionBy("source_id").orderBy("hour"))
    gaps = active.withColumn("previous_run_at", previous).select("source_id", "first.run_id", "previous_run_at", "first.started_at")
    return gaps.where(F.col("started_at") - F.expr(f"INTERVAL {hours} HOUR") > F.col("previous_run_at"))


def digest_sections(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Markdown section of each story, with its place in the company's digest.  Writing the sections sorted by
    (company_id, newest first) gives the document; no company is gathered in one task."""
    stories = story_groups(articles.withColumn("title", F.coalesce(F.nullif("analysis.translated_title", F.lit("")), "title")))
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("Publication date unknown"))
    facts = F.concat_ws(" · ", day, F.col("region"), F.col("analysis.event_type"), F.col("analysis.sentiment"))
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("title")), facts, F.col("analysis.summary"),
                          F.concat(F.lit("Source: "), F.col("source_id")), F.concat(F.lit("Uncertainty: "), F.col("analysis.uncertainty")))
    return stories.join(companies.select("company_id", "name"), "company_id").select(
        "company_id", "name", "cluster_id", "article_id", event_time().alias("event_time"), section.alias("section"))


def write_digests(sections: DataFrame, path: str) -> None:
    """One folder per company; hot companies are split over files by time range, in digest order."""
    ordered = sections.repartitionByRange("company_id", F.col("event_time").desc(), "article_id").sortWithinPartitions(
        "company_id", F.col("event_time").desc(), "article_id")
    ordered.select("company_id", "section").write.mode("overwrite").partitionBy("company_id").text(path)
