"""Input tables of the registered queries, derived from the given parquet tables.

Everything is computed from whole tables.  The article table, which many reports read, is written once per
session to the shared folder, as an ingest job would store it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text, url
from newsweave.functions.binding import let
from newsweave.operators import articles as build
from newsweave.operators import clustering
from newsweave.operators.matching import entity_match
from newsweave.session import scratch_path

# Rules over the invented words of the test corpus, in the form of the fixed event and tone rules.
EVENT_RULES = (
    ("Alpha", r"\b(erin|anea|thle)\b"),
    ("Beta", r"\b(dans|éeau)\b|étion"),
    ("Gamma", r"\b(sich|nicht)\b|ción"),
    ("Delta", r"\b(that|w\w+h)\b"),
)
TONE_RULES = (
    r"\b(ther|pour|eine)\b",
    r"\b(thon|avec|enau|thes)\b",
    r"\b(not|no|this|der)\b[^\n\r\x{2028}\x{2029}]{0,35}\b(thon|avec|enau)\b",
)

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Derived table written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        make().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def arriving(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, file: Column, pieces: int, last: Callable[[DataFrame, str], None]) -> str:
    """Folder of the rows dealt to numbered files, written in the order of their numbers, `pieces` parts each, as they would arrive; `last` adds what closes the stream."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        dealt = rows.withColumn("_file", file)
        for r in dealt.select("_file").distinct().orderBy("_file").collect():  # one row per file
            dealt.where(F.col("_file") == r["_file"]).drop("_file").repartition(pieces).write.mode("append").parquet(path)
        last(rows, path)
        _STORED[key] = path
    return _STORED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute an input that has fewer splits than the cluster has cores (a small file of one row group);
    large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def region_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in K.REGIONS]), number.cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected items: every tenth repeats the address of its neighbour, some dates are unknown."""
    uid = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    s = lambda c: c.cast("string")
    day = F.expr("make_interval(0, 0, 0, cast(doc_id % 20 as int))")
    minute = F.expr("make_interval(0, 0, 0, 0, 0, cast(doc_id as int))")
    return documents(spark, sf_dir).withColumn("uid", uid).select(
        F.col("doc_id").alias("item_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.concat(F.lit("https://src"), s(F.col("uid") % 20), F.lit(".example.com/a/"), s(F.col("uid")), F.lit("/?utm_source=rss&id="), s(F.col("uid")), F.lit("#top")).alias("url"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 17 != 0, F.lit("2024-01-01 08:30:00").cast("timestamp") + day).alias("published_at"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp") + minute).alias("fetched_at"),
        region_name(F.col("doc_id") % 39).alias("region"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty entities named by frequent words of six letters or more, each with a two-word alias."""

    def make() -> DataFrame:
        runs = F.regexp_extract_all(F.lower("text"), F.lit(K.WORD_RUN.replace("+", "{6,}")), F.lit(0))
        words = documents(spark, sf_dir).select(F.explode(F.array_distinct(runs)).alias("word"))
        common = words.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(50)
        # fifty rows
        ranked = common.withColumn("rk", F.row_number().over(Window.orderBy(F.col("count").desc(), "word"))).select("rk", "word")
        other = ranked.select((F.col("rk") - 20).alias("rk"), F.col("word").alias("other"))
        return ranked.where(F.col("rk").between(11, 30)).join(other, "rk").select(
            F.concat(F.lit("c"), (F.col("rk") - 10).cast("string")).alias("company_id"),
            F.col("word").alias("name"),
            F.array(F.concat("other", F.lit(" the"))).alias("aliases"),
            F.concat("word", F.lit(".example.com")).alias("domain"),
            F.lit(False).alias("demo"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        )

    return stored(spark, sf_dir, "watchlist", make)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log from the event table, with messages for the failure categories."""
    n = F.col("event_id") % 7
    message = (
        F.when(n == 0, "disallowed in robots.txt").when(n == 1, "HTTP 403").when(n == 2, "HTTP 429").when(n == 3, "HTTP 404")
        .when(n == 4, "request timed out").when(n == 5, "hostname could not be resolved").otherwise("broken stream")
    )
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(kind == "error", "error").when(kind == "view", "partial").otherwise("success").alias("status"),
        F.when(kind == "error", message).alias("error"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per `source_id` of the run log, with the state left by its latest run."""
    latest = runs(spark, sf_dir).groupBy("source_id").agg(
        F.max("started_at").alias("last"), F.max_by(F.struct("status", "error"), F.struct("started_at", "run_id")).alias("r"))
    n = F.substring("source_id", 4, 10).cast("int")
    kind = F.get(F.array(F.lit("rss"), F.lit("web"), F.lit("discovery")), n % 3)
    language = F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), n % 4)
    unfetched = n % 11 == 10
    return latest.select(
        "source_id",
        F.concat(F.lit("Source "), F.lpad(n.cast("string"), 2, "0")).alias("name"),
        F.concat(F.lit("https://www.src"), n.cast("string"), F.lit(".example.com/rss")).alias("url"),
        kind.alias("kind"),
        region_name((n * 2) % 39).alias("region"),
        language.alias("language"),
        (n % 7 != 3).alias("enabled"),
        F.when(unfetched, "unfetched").when(F.col("r.status") == "error", "error").otherwise("healthy").alias("status"),
        F.when(~unfetched, F.col("last")).alias("last_fetched_at"),
        F.when(~unfetched, F.col("r.error")).alias("error"),
        F.when(n % 5 == 0, F.concat(F.lit("Publisher "), (n % 3).cast("string"))).alias("publisher"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (item, company) matches, which several jobs read."""
    return stored(spark, sf_dir, "matches", lambda: entity_match(items(spark, sf_dir), watchlist(spark, sf_dir)))


def _mode() -> Column:
    return F.when(F.col("item_id") % 4 == 0, "model").otherwise("baseline")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (company_id, url, item_id) of the articles, which need no analysis."""
    return stored(spark, sf_dir, "chosen", lambda: build.choose_items(items(spark, sf_dir), watchlist(spark, sf_dir), matches(spark, sf_dir)))


def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without what is computed from their texts, for jobs that need keys, dates and state only."""

    def make() -> DataFrame:
        known = items(spark, sf_dir).select("item_id", "source_id", "region", "published_at", "fetched_at")
        return chosen(spark, sf_dir).join(known, "item_id").select(
            build.article_id().alias("article_id"), "company_id", "item_id", "source_id", "url", "region", "published_at", "fetched_at", F.struct(_mode().alias("mode")).alias("analysis"), F.lit(False).alias("demo"))

    return stored(spark, sf_dir, "article_index", make)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles without their cluster; every fourth counts as enriched by a model."""

    def make() -> DataFrame:
        rows = build.build_articles(items(spark, sf_dir), watchlist(spark, sf_dir), event_rules=EVENT_RULES, tone_rules=TONE_RULES,
                                    chosen=chosen(spark, sf_dir))
        return rows.withColumn("analysis", let(F.col("analysis"), lambda a: a.withField("mode", _mode()))).withColumn(
            "publisher", F.regexp_replace(url.host(F.col("url")), "^www[.]", ""))

    return stored(spark, sf_dir, "articles", make)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles with their story."""

    def make() -> DataFrame:
        base = articles(spark, sf_dir)
        return base.join(clustering.story_clusters(base), "article_id")

    return stored(spark, sf_dir, "clustered", make)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("all").alias("scope"))




# Derived tables that several queries share, in the order they build on each other.
SHARED = {"watchlist": watchlist, "matches": matches, "chosen": chosen, "article_index": article_index, "articles": articles, "clustered": clustered}
