"""Registered queries: matching, grouping and coverage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text
from newsweave.operators import admission, clustering, filters, matching, merge, quality, reports
from newsweave.operators import ranking
from newsweave.plans import check_sql as S
from newsweave.plans import inputs
from newsweave.plans.registry import registered

NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _sql_ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- joins ------------------------------------------------------------------------------------------------

@registered("entity_match_words", S.with_views("items", r"""
    , t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(nfc_normalize(title)), '[\p{L}\p{M}\p{N}]+')) AS w FROM items)
    SELECT item_id, w AS company_id FROM t WHERE length(w) >= 6"""))
def entity_match_words(spark, sf):
    """Every word of six letters or more is an entity, so the aliases grow with the corpus and are joined by shuffle at size."""
    items = inputs.items(spark, sf).select("item_id", "title")
    words = items.select(F.explode(F.array_distinct(text.word_runs(text.normalize(F.col("title"))))).alias("name")).where(F.length("name") >= 6).distinct()
    companies = words.select(F.col("name").alias("company_id"), "name", F.array().cast("array<string>").alias("aliases"))
    return matching.entity_match(items, companies, body=F.col("title"))


@registered("entity_match", S.with_views("matches", "SELECT item_id, company_id FROM matches"))
def entity_match(spark, sf):
    return matching.entity_match(inputs.items(spark, sf), inputs.watchlist(spark, sf))


@registered("build_articles", S.with_views("articles", """
    SELECT article_id, company_id, item_id, source_name, url, language, region, content_hash, event_type, sentiment, summary FROM articles"""))
def build_articles(spark, sf):
    return inputs.articles(spark, sf).select("article_id", "company_id", "item_id", "source_name", "url", "language", "region", "content_hash",
                                             "analysis.event_type", "analysis.sentiment", "analysis.summary")


@registered("near_dup_pairs", S.with_views("near_pairs", """
    , v AS (SELECT company_id, content_hash, published_at, article_id AS any_id,
        first_value(article_id) OVER (PARTITION BY company_id, content_hash, published_at, title ORDER BY fetched_at, article_id) AS variant_id FROM articles)
    SELECT DISTINCT p.company_id, least(a.variant_id, b.variant_id) AS left_id, greatest(a.variant_id, b.variant_id) AS right_id,
      round(title_similarity, 6) AS title_similarity, round(text_similarity, 6) AS text_similarity
    FROM near_pairs p JOIN v a ON a.any_id = p.a_id JOIN v b ON b.any_id = p.b_id"""))
def near_dup_pairs(spark, sf):
    pairs = clustering.near_duplicate_pairs(inputs.articles(spark, sf))
    return pairs.select("company_id", F.col("left_variant_id").alias("left_id"), F.col("right_variant_id").alias("right_id"),
                        F.round("title_similarity", 6).alias("title_similarity"), F.round("text_similarity", 6).alias("text_similarity"))


@registered("story_clusters", S.with_views("roots", "SELECT article_id, cluster_id FROM roots"))
def story_clusters(spark, sf):
    return inputs.clustered(spark, sf).select("article_id", "cluster_id")


@registered("story_groups", S.with_views("stories", "SELECT company_id, cluster_id, article_id, group_size, row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, article_id) AS position FROM stories"))
def story_groups(spark, sf):
    groups = clustering.story_groups(inputs.clustered(spark, sf)).withColumn("t", ranking.newest(clustering.event_time()))
    placed = ranking.full_rank(groups, ["company_id"], [F.floor(F.col("t") / 86_400_000_000), F.floor(F.col("t") / 1_000_000), F.col("t"), F.substring("article_id", 1, 3)], [F.col("t"), F.col("article_id")], "position")
    return placed.select("company_id", "cluster_id", "article_id", "group_size", F.col("position").cast("long").alias("position"))


@registered("publisher_resolve", S.with_views("sources", f"""
    , u AS (SELECT DISTINCT replace(regexp_replace(url, '^http://', 'https://'), '://', CASE WHEN page_id % 3 = 0 THEN '://news.' ELSE '://' END) AS url FROM pages
        UNION SELECT 'https://' || CASE WHEN doc_id % 3 = 0 THEN 'm.' WHEN doc_id % 3 = 1 THEN 'www.' ELSE 'not' END || source || '.example.com/a/' || doc_id FROM documents),
    d AS (SELECT source_id, name, regexp_replace({S.host('url')}, '^(www|feeds?|rss)[.]', '') AS domain FROM sources WHERE enabled
        UNION SELECT min(page_id) || 'p' AS source_id, 'Z ' || {S.host('url')} AS name, regexp_replace({S.host('url')}, '^(www|feeds?|rss)[.]', '') FROM pages GROUP BY {S.host('url')}),
    c AS (SELECT u.url, d.name, d.source_id FROM u JOIN d ON regexp_replace({S.host('u.url')}, '^www[.]', '') = d.domain OR ends_with({S.host('u.url')}, '.' || d.domain))
    SELECT url, arg_min(source_id, struct_pack(a := name, b := source_id)) AS source_id, min(name) AS source_name FROM c GROUP BY url"""))
def publisher_resolve(spark, sf):
    from newsweave.functions import url

    pages = inputs.pages(spark, sf)
    prefix = F.when(F.col("page_id") % 3 == 0, "://news.").otherwise("://")
    links = pages.select(F.replace(F.regexp_replace("url", "^http://", "https://"), F.lit("://"), prefix).alias("url")).unionByName(
        inputs.documents(spark, sf).select(F.concat(
            F.lit("https://"), F.when(F.col("doc_id") % 3 == 0, "m.").when(F.col("doc_id") % 3 == 1, "www.").otherwise("not"),
            F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url")))
    hosts = pages.groupBy(url.host(F.col("url")).alias("h")).agg(F.min("page_id").alias("p")).select(
        F.concat(F.col("p").cast("string"), F.lit("p")).alias("source_id"), F.concat(F.lit("Z "), F.col("h")).alias("name"),
        F.concat(F.lit("https://"), F.col("h"), F.lit("/")).alias("url"), F.lit(True).alias("enabled"))
    monitored = inputs.sources(spark, sf).select("source_id", "name", "url", "enabled").unionByName(hosts)
    return matching.publisher_resolve(links, monitored)


@registered("zone_lookup", S.with_views("items sources", f"""
    SELECT i.item_id, {S.zone('i.region')} AS zone, coalesce(s.publisher, regexp_replace({S.host('s.url')}, '^www[.]', ''), i.source_id) AS publisher
    FROM items i LEFT JOIN sources s ON s.source_id = i.source_id"""))
def zone_lookup(spark, sf):
    named = inputs.sources(spark, sf).withColumn("publisher", matching.source_publisher(F.col("publisher"), F.col("url")))
    rows = inputs.items(spark, sf).select("item_id", "source_id", matching.zone_of(F.col("region")).alias("zone"))
    return matching.lookup(rows, named, "source_id", "publisher", F.col("source_id")).select("item_id", "zone", "publisher")


@registered("dedupe_url_anti", S.with_views("matches items", f"""
    , p AS (SELECT m.company_id, {S.canonical('i.url')} AS url, i.item_id, i.source_id FROM matches m JOIN items i USING (item_id)),
    t AS (SELECT DISTINCT company_id, url FROM p WHERE item_id % 3 = 0)
    SELECT p.source_id, count(*) FILTER (WHERE t.url IS NULL) AS fresh, count(*) FILTER (WHERE t.url IS NOT NULL) AS duplicates
    FROM p LEFT JOIN t ON t.company_id = p.company_id AND t.url = p.url GROUP BY p.source_id"""))
def dedupe_url_anti(spark, sf):
    from newsweave.functions import url

    located = inputs.items(spark, sf).select("item_id", "source_id", url.canonical_url(F.col("url")).alias("url"))
    pairs = inputs.matches(spark, sf).join(located, "item_id")
    known = pairs.where("item_id % 3 = 0").select("company_id", "url")
    checked = merge.split_known(known, pairs, ["company_id", "url"])
    return checked.groupBy("source_id").agg(F.count_if("is_new").alias("fresh"), F.count_if(~F.col("is_new")).alias("duplicates"))


# --- reports ------------------------------------------------------------------------------------------------

@registered("coverage_by_company", S.with_views("articles watchlist", f"""
    SELECT w.company_id, w.name, count(a.article_id) AS stored, count(*) FILTER (WHERE a.mode = 'model') AS enriched,
      {_sql_ts('min(a.published_at)')} AS earliest, {_sql_ts('max(a.published_at)')} AS latest
    FROM (SELECT company_id, name FROM watchlist UNION ALL SELECT 'none', 'zz no coverage') w LEFT JOIN articles a ON a.company_id = w.company_id GROUP BY ALL"""))
def coverage_by_company(spark, sf):
    companies = inputs.watchlist(spark, sf).select("company_id", "name")
    extra = companies.limit(1).select(F.lit("none").alias("company_id"), F.lit("zz no coverage").alias("name"))
    report = reports.coverage_by_company(inputs.article_index(spark, sf), companies.unionByName(extra))
    return report.withColumn("earliest", _ts("earliest")).withColumn("latest", _ts("latest"))


@registered("coverage_kpis", S.with_views("clustered stories", """
    , t AS (SELECT company_id, count(DISTINCT sentiment) > 1 AS several_tones FROM stories GROUP BY company_id)
    SELECT c.company_id, count(*) AS articles, count(DISTINCT cluster_id) AS stories, count(*) - count(DISTINCT cluster_id) AS repeats,
      count(DISTINCT publisher) AS publishers, count(*) FILTER (WHERE region NOT IN ('India', 'Global')) AS regional, count(DISTINCT language) AS languages,
      count(*) FILTER (WHERE mode = 'baseline') AS baseline, arg_min(summary, struct_pack(a := -epoch_us(event_time), b := article_id)) AS newest_summary, any_value(several_tones) AS several_tones
    FROM clustered c JOIN t ON t.company_id = c.company_id GROUP BY c.company_id"""))
def coverage_kpis(spark, sf):
    return reports.coverage_kpis(inputs.clustered(spark, sf))


@registered("tone_by_story", S.with_views("stories", f"""
    , n AS (SELECT company_id, count(*) AS total FROM stories GROUP BY 1), g AS (SELECT n.*, unnest({S.sql_list(K.TONES)}) AS tone FROM n)
    SELECT g.company_id, g.tone, count(s.article_id) AS n, count(s.article_id) / any_value(g.total) * 100 AS share
    FROM g LEFT JOIN stories s ON s.company_id = g.company_id AND s.sentiment = g.tone GROUP BY 1, 2"""))
def tone_by_story(spark, sf):
    return reports.tone_by_story(inputs.clustered(spark, sf))


@registered("zone_footprint", S.with_views("articles", f"""
    , n AS (SELECT company_id, count(*) AS total FROM articles GROUP BY 1), g AS (SELECT n.*, unnest({S.sql_list(K.ZONES)}) AS zone FROM n)
    SELECT g.company_id, g.zone, count(a.article_id) AS n, count(a.article_id) / any_value(g.total) * 100 AS share
    FROM g LEFT JOIN articles a ON a.company_id = g.company_id AND {S.zone('a.region')} = g.zone GROUP BY 1, 2"""))
def zone_footprint(spark, sf):
    return reports.zone_footprint(inputs.articles(spark, sf))


@registered("zone_tone_pivot", S.with_views("articles", f"""
    SELECT {S.zone('region')} AS zone, count(*) AS articles, {', '.join(f"count(*) FILTER (WHERE sentiment = '{t}') AS {t}" for t in K.TONES)} FROM articles GROUP BY 1"""))
def zone_tone_pivot(spark, sf):
    return reports.zone_tone_pivot(inputs.articles(spark, sf))


@registered("run_metrics", S.with_views("items matches", f"""
    , p AS (SELECT i.source_id, m.item_id, m.company_id, i.item_id % 3 <> 0 AS is_new FROM matches m JOIN items i USING (item_id)),
    a AS (SELECT source_id, count(DISTINCT item_id) AS mi, count(*) AS mp, count(*) FILTER (WHERE is_new) AS ins, count(*) FILTER (WHERE NOT is_new) AS dup FROM p GROUP BY 1),
    s AS (SELECT source_id, count(*) AS scanned FROM items GROUP BY 1)
    SELECT s.source_id, scanned, coalesce(mi, 0) AS matched_items, coalesce(mp, 0) AS matched_pairs, coalesce(ins, 0) AS inserted, coalesce(dup, 0) AS duplicates
    FROM s LEFT JOIN a ON a.source_id = s.source_id"""))
def run_metrics(spark, sf):
    items = inputs.items(spark, sf)
    pairs = inputs.matches(spark, sf).join(items.select("item_id", "source_id"), "item_id").withColumn(
        "is_new", F.col("item_id") % 3 != 0)
    return reports.run_metrics(items.select("item_id", "source_id"), pairs)


@registered("run_status", S.with_views("runs", """
    , o AS (SELECT source_id || '-' || strftime(started_at, '%Y-%m-%d') AS run_id, CASE WHEN run_id % 11 = 0 THEN error END AS error,
        CASE WHEN status = 'partial' THEN 'limit ' || (run_id % 4) END AS warning, run_id % 13 = 0 AS truncated FROM runs),
    w AS (SELECT run_id, string_agg(warning, ' ' ORDER BY warning) AS warnings FROM (SELECT DISTINCT run_id, warning FROM o WHERE warning IS NOT NULL) GROUP BY 1)
    SELECT o.run_id, CASE WHEN count(error) > 0 THEN 'error' WHEN count(warning) > 0 OR bool_or(truncated) THEN 'partial' ELSE 'success' END AS status,
      coalesce(min(error), any_value(warnings)) AS message FROM o LEFT JOIN w ON w.run_id = o.run_id GROUP BY o.run_id"""))
def run_status(spark, sf):
    n = F.col("run_id")
    outcomes = inputs.runs(spark, sf).select(
        F.concat("source_id", F.lit("-"), F.date_format("started_at", "yyyy-MM-dd")).alias("run"),
        F.when(n % 11 == 0, F.col("error")).alias("error"),
        F.when(F.col("status") == "partial", F.concat(F.lit("limit "), (n % 4).cast("string"))).alias("warning"),
        (n % 13 == 0).alias("truncated")).withColumnRenamed("run", "run_id")
    return reports.run_status(outcomes)


@registered("source_health", S.with_views("sources", """
    SELECT language, count(*) AS sources, count(*) FILTER (WHERE status = 'healthy') AS healthy, count(*) FILTER (WHERE status = 'error') AS error,
      count(*) FILTER (WHERE status = 'unfetched') AS unfetched, count(*) FILTER (WHERE NOT enabled) AS paused, count(*) FILTER (WHERE region = 'Global') AS global_sources,
      count(DISTINCT coalesce(publisher, url)) AS publishers FROM sources GROUP BY language"""))
def source_health(spark, sf):
    return reports.source_health(inputs.sources(spark, sf).withColumn("publisher", F.coalesce("publisher", "url")))


@registered("zone_health", S.with_views("sources", f"""
    , z AS (SELECT DISTINCT unnest({S.sql_list([*(z for z, _ in K.ZONE_REGIONS), K.DEFAULT_ZONE])}) AS zone),
    s AS (SELECT *, {S.zone('region')} AS zone, coalesce(publisher, url) AS p FROM sources)
    SELECT z.zone, count(source_id) AS sources, count(*) FILTER (WHERE enabled AND status = 'healthy') AS healthy, count(*) FILTER (WHERE enabled AND status = 'error') AS error,
      count(*) FILTER (WHERE enabled AND status = 'unfetched') AS unfetched, count(*) FILTER (WHERE NOT enabled) AS paused, count(DISTINCT language) AS languages, count(DISTINCT p) AS publishers
    FROM z LEFT JOIN s ON s.zone = z.zone GROUP BY z.zone"""))
def zone_health(spark, sf):
    return reports.zone_health(inputs.sources(spark, sf).withColumn("publisher", F.coalesce("publisher", "url")))


@registered("error_taxonomy", S.with_views("runs", f"""
    SELECT {S.rule_case('error', K.FAILURE_RULES, K.DEFAULT_FAILURE)} AS category, count(*) AS n,
      CASE {' '.join(f"WHEN {S.rule_case('any_value(error)', K.FAILURE_RULES, K.DEFAULT_FAILURE)} = {S.q(c)} THEN {S.q(a)}" for c, a in K.FAILURE_ACTIONS.items())} END AS action
    FROM runs WHERE error IS NOT NULL GROUP BY 1"""))
def error_taxonomy(spark, sf):
    return reports.error_taxonomy(inputs.runs(spark, sf))


_JOBS_SQL = """j AS (SELECT company_id, 'job-' || company_id AS job_id, CAST('2024-01-03' AS DATE) + CAST(substr(company_id, 2) AS INT) % 5 AS from_day,
    CAST('2024-01-12' AS DATE) + CAST(substr(company_id, 2) AS INT) % 9 AS to_day FROM watchlist)"""


def _jobs(spark, sf):
    n = F.substring("company_id", 2, 10).cast("int")
    return inputs.watchlist(spark, sf).select(
        "company_id", F.concat(F.lit("job-"), F.col("company_id")).alias("job_id"),
        F.date_add(F.lit("2024-01-03").cast("date"), n % 5).alias("from_day"), F.date_add(F.lit("2024-01-12").cast("date"), n % 9).alias("to_day"))


@registered("import_outcomes", S.with_views("items matches watchlist", f"""
    , {_JOBS_SQL}, c AS (SELECT j.job_id, j.from_day, j.to_day, i.item_id, i.published_at, {S.canonical('i.url')} AS url, m.item_id IS NOT NULL AS matched
        FROM j JOIN items i ON i.item_id % 20 = CAST(substr(j.company_id, 2) AS INT) % 20 LEFT JOIN matches m ON m.item_id = i.item_id AND m.company_id = j.company_id),
    o AS (SELECT job_id, CASE WHEN item_id % 50 = 49 THEN NULL WHEN item_id % 23 = 0 THEN 'failed'
        WHEN row_number() OVER (PARTITION BY job_id, url ORDER BY item_id) > 1 THEN 'duplicates' WHEN published_at IS NULL THEN 'unknownDate'
        WHEN CAST(published_at AS DATE) NOT BETWEEN from_day AND to_day THEN 'outsideRange' WHEN NOT matched THEN 'unmatched' ELSE 'imported' END AS outcome FROM c),
    n AS (SELECT job_id, count(*) AS collected, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in reports.OUTCOMES)}, count(*) FILTER (WHERE outcome IS NULL) AS pending FROM o GROUP BY 1)
    SELECT *, CAST(floor(100 * (collected - pending) / collected) AS INTEGER) AS progress,
      CASE WHEN pending > 0 THEN 'running' WHEN failed + unknownDate + outsideRange > 0 THEN 'partial' ELSE 'completed' END AS status FROM n"""))
def import_outcomes(spark, sf):
    from newsweave.functions import dates, url

    items = inputs.items(spark, sf)
    jobs = _jobs(spark, sf).withColumn("slot", F.substring("company_id", 2, 10).cast("int") % 20)
    matched = inputs.matches(spark, sf).withColumn("matched", F.lit(True))
    slim = items.select("item_id", "published_at", url.canonical_url(F.col("url")).alias("url"), (F.col("item_id") % 20).cast("int").alias("slot"))
    candidates = slim.join(jobs, "slot").join(matched, ["item_id", "company_id"], "left")
    first = candidates.groupBy("job_id", "url").agg(F.min("item_id").alias("first_id"))
    eligible = dates.date_eligibility(F.col("published_at"), F.col("from_day"), F.col("to_day"))
    outcome = (
        F.when(F.col("item_id") % 50 == 49, F.lit(None)).when(F.col("item_id") % 23 == 0, "failed").when(F.col("item_id") > F.col("first_id"), "duplicates")
        .when(eligible != "eligible", eligible).when(F.col("matched").isNull(), "unmatched").otherwise("imported")
    )
    return reports.import_outcomes(candidates.join(first, ["job_id", "url"]).select("job_id", outcome.alias("outcome")))


@registered("coverage_gaps", S.with_views("articles watchlist", f"""
    , {_JOBS_SQL}, t AS (SELECT company_id, CAST(unnest(generate_series(from_day, to_day, INTERVAL 7 DAY)) AS DATE) AS tile_start, to_day FROM j),
    e AS (SELECT company_id, tile_start, least(tile_start + 6, to_day) AS tile_end FROM t)
    SELECT e.company_id, strftime(tile_start, '%Y-%m-%d') AS tile_start, strftime(tile_end, '%Y-%m-%d') AS tile_end, count(a.article_id) AS results,
      CASE WHEN count(a.article_id) >= 20 THEN 'incomplete' WHEN count(a.article_id) = 0 THEN 'gap' ELSE 'ok' END AS flag
    FROM e LEFT JOIN articles a ON a.company_id = e.company_id AND CAST(a.published_at AS DATE) BETWEEN tile_start AND tile_end GROUP BY ALL"""))
def coverage_gaps(spark, sf):
    tiles = admission.date_tiles(_jobs(spark, sf)).select("company_id", "tile_start", "tile_end")
    found = inputs.articles(spark, sf).where("published_at is not null").select("company_id", F.to_date("published_at").alias("day"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return reports.coverage_gaps(tiles, found, "company_id", cap=20).select("company_id", day("tile_start"), day("tile_end"), "results", "flag")


@registered("date_tiles", S.with_views("watchlist", f"""
    , {_JOBS_SQL}, t AS (SELECT company_id, from_day, to_day, CAST(unnest(generate_series(from_day, to_day, INTERVAL 7 DAY)) AS DATE) AS s FROM j)
    SELECT company_id, strftime(s, '%Y-%m-%d') AS tile_start, strftime(least(s + 6, to_day), '%Y-%m-%d') AS tile_end, CAST((s - from_day) // 7 AS INTEGER) AS tile_no,
      CAST(ceil((to_day - from_day + 1) / 7) AS INTEGER) AS tiles FROM t
    UNION ALL SELECT 'order-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d'), 0, 1 FROM orders"""))
def date_tiles(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("company_id"),
                                                      F.to_date("o_orderdate").alias("from_day"), F.date_add(F.to_date("o_orderdate"), 2).alias("to_day"))
    ranges = _jobs(spark, sf).select("company_id", "from_day", "to_day").unionByName(orders)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return admission.date_tiles(ranges).select("company_id", day("tile_start"), day("tile_end"), "tile_no", "tiles")


_QUEUE_SQL = """q AS (SELECT CAST(run_id AS VARCHAR) AS job_id, CASE WHEN run_id % 5 < 3 THEN 'backfill' ELSE 'document' END AS kind,
    (['queued', 'running', 'completed', 'partial', 'failed', 'review', 'paused', 'waiting-key'])[run_id % 8 + 1] AS status, started_at AS updated_at FROM runs)"""


@registered("backlog_summary", S.with_views("runs", f"""
    , {_QUEUE_SQL} SELECT kind, count(*) AS runnable, arg_min(job_id, struct_pack(a := updated_at, b := job_id)) AS next_job, {_sql_ts('min(updated_at)')} AS oldest
    FROM q WHERE status IN ('queued', 'running') GROUP BY kind"""))
def backlog_summary(spark, sf):
    n = F.col("run_id")
    states = F.array(*[F.lit(s) for s in ("queued", "running", "completed", "partial", "failed", "review", "paused", "waiting-key")])
    jobs = inputs.runs(spark, sf).select(n.cast("string").alias("job_id"), F.when(n % 5 < 3, "backfill").otherwise("document").alias("kind"),
                                         F.get(states, (n % 8).cast("int")).alias("status"), F.col("started_at").alias("updated_at"))
    return reports.backlog_summary(jobs).withColumn("oldest", _ts("oldest"))


@registered("schedule_status", S.with_views("runs", f"""
    , l AS (SELECT source_id, max(started_at) AS last_run_at, arg_max(status, struct_pack(a := started_at, b := run_id)) AS last_status FROM runs GROUP BY 1)
    SELECT source_id, {_sql_ts('last_run_at')} AS last_run_at, {_sql_ts("last_run_at + INTERVAL 3 HOUR")} AS next_run_at,
      CASE WHEN source_id = 'src7' THEN 'paused' WHEN last_status = 'error' THEN 'error' WHEN {NOW_SQL} - last_run_at > INTERVAL 6 HOUR THEN 'delayed' ELSE 'current' END AS state FROM l"""))
def schedule_status(spark, sf):
    rows = reports.schedule_status(inputs.runs(spark, sf), _now(), F.col("source_id") == "src7")
    return rows.withColumn("last_run_at", _ts("last_run_at")).withColumn("next_run_at", _ts("next_run_at"))


@registered("run_gaps", S.with_views("runs", f"""
    , g AS (SELECT *, lag(started_at) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS previous_run_at FROM runs)
    SELECT source_id, run_id, {_sql_ts('previous_run_at')} AS previous_run_at, {_sql_ts('started_at')} AS started_at FROM g WHERE started_at - previous_run_at > INTERVAL 4 HOUR"""))
def run_gaps(spark, sf):
    rows = reports.run_gaps(inputs.runs(spark, sf), hours=4)
    return rows.withColumn("previous_run_at", _ts("previous_run_at")).withColumn("started_at", _ts("started_at"))


@registered("digest_sections", S.with_views("stories watchlist", f"""
    SELECT s.company_id, w.name, s.cluster_id, s.article_id, {_sql_ts('s.event_time')} AS event_time,
      '## ' || title || chr(10) || chr(10) || coalesce(strftime(published_at, '%Y-%m-%d'), 'Publication date unknown') || ' · ' || region || ' · ' || event_type || ' · ' || sentiment
      || chr(10) || chr(10) || summary || chr(10) || chr(10) || 'Source: ' || source_id || chr(10) || chr(10) || 'Uncertainty: ' || {S.q(K.BASELINE_UNCERTAINTY)} AS section
    FROM stories s JOIN watchlist w ON w.company_id = s.company_id"""))
def digest_sections(spark, sf):
    return reports.digest_sections(inputs.clustered(spark, sf), inputs.watchlist(spark, sf)).withColumn("event_time", _ts("event_time"))


# --- scans, windows and filters ---------------------------------------------------------------------------------

@registered("scan_company_latest", S.with_views("articles", f"SELECT article_id, {_sql_ts('event_time')} AS event_time FROM articles WHERE company_id = 'c1' ORDER BY articles.event_time DESC, article_id LIMIT 30"))
def scan_company_latest(spark, sf):
    return filters.latest_articles(inputs.articles(spark, sf), "c1", 30).select("article_id", _ts(clustering.event_time()).alias("event_time"))


@registered("scan_runs_latest", S.with_views("runs", f"SELECT run_id, source_id, {_sql_ts('started_at')} AS started_at, status FROM runs ORDER BY runs.started_at DESC, run_id LIMIT 150"))
def scan_runs_latest(spark, sf):
    from newsweave.sources import tables

    return tables.latest_runs(inputs.runs(spark, sf), K.RUN_HISTORY).select("run_id", "source_id", _ts("started_at").alias("started_at"), "status")


@registered("latest_per_company", S.with_views("articles", "SELECT company_id, article_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, article_id) AS INTEGER) AS rank FROM articles QUALIFY rank <= 25"))
def latest_per_company(spark, sf):
    rows = inputs.article_index(spark, sf).select("company_id", "article_id", ranking.newest(clustering.event_time()).alias("t"))
    return ranking.top_k(rows, ["company_id"], [F.col("t"), F.col("article_id")], 25).select("company_id", "article_id", "rank")


@registered("project_public", S.with_views("articles", """
    SELECT a.article_id, a.company_id, a.url, a.sentiment FROM articles a"""))
def project_public(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    full = inputs.articles(spark, sf).join(vectors, "item_id", "left")
    return filters.project_public(full).select("article_id", "company_id", "url", "analysis.sentiment")


@registered("timeline_filter", S.with_views("articles", f"""
    SELECT article_id, title FROM articles WHERE company_id = 'c2' AND sentiment = 'mixed' AND language = 'en'
      AND contains(lower(title || ' ' || text || ' ' || source_name), 'the') AND published_at >= {NOW_SQL} - INTERVAL 25 DAY"""))
def timeline_filter(spark, sf):
    return filters.timeline(inputs.articles(spark, sf), "c2", "mixed", "en", "THE", 25, _now()).select("article_id", "title")


@registered("source_filter", S.with_views("sources", f"""
    , p AS (SELECT *, coalesce(publisher, regexp_replace({S.host('url')}, '^www[.]', '')) AS pub, {S.zone('region')} AS zone FROM sources)
    SELECT 'zone' AS filter, source_id FROM p WHERE zone = 'South' UNION ALL SELECT 'paused', source_id FROM p WHERE NOT enabled UNION ALL SELECT 'enabled', source_id FROM p WHERE enabled
    UNION ALL SELECT 'error', source_id FROM p WHERE status = 'error' AND language = 'en' UNION ALL SELECT 'search', source_id FROM p WHERE contains(lower(name || ' ' || region || ' ' || pub || ' ' || url), 'src1')
    UNION ALL SELECT 'region', source_id FROM p WHERE region = 'Kerala'"""))
def source_filter(spark, sf):
    s = inputs.sources(spark, sf)
    views = {"zone": filters.source_directory(s, zone="South"), "paused": filters.source_directory(s, health="paused"), "enabled": filters.source_directory(s, health="enabled"),
             "error": filters.source_directory(s, health="error", language="en"), "search": filters.source_directory(s, search="SRC1"), "region": filters.source_directory(s, region="Kerala")}
    out = None
    for name, view in views.items():
        part = view.select(F.lit(name).alias("filter"), "source_id")
        out = part if out is None else out.unionByName(part)
    return out


@registered("source_page", S.with_views("sources", "SELECT source_id, name FROM sources ORDER BY name LIMIT 12 OFFSET 12"))
def source_page(spark, sf):
    return filters.page_of(inputs.sources(spark, sf).select("source_id", "name"), [F.col("name")], page=7)


@registered("watchlist_search", S.with_views("watchlist", "SELECT company_id, name FROM watchlist WHERE contains(lower(name || ' ' || alias), 'th')"))
def watchlist_search(spark, sf):
    return filters.watchlist_search(inputs.watchlist(spark, sf), "TH").select("company_id", "name")


@registered("due_sources", S.with_views("sources", f"""
    SELECT source_id, {_sql_ts('last_fetched_at')} AS last_fetched_at FROM sources WHERE enabled AND (last_fetched_at IS NULL OR last_fetched_at <= TIMESTAMP '2024-01-31 02:00:00' - INTERVAL 3 HOUR) AND source_id <> 'src1'"""))
def due_sources(spark, sf):
    s = inputs.sources(spark, sf)
    now = F.lit("2024-01-31 02:00:00").cast("timestamp")
    return filters.due_sources(s, now, seed=s.where("source_id = 'src1'")).select("source_id", _ts("last_fetched_at").alias("last_fetched_at"))


@registered("date_eligibility", S.with_views("items", """
    SELECT item_id, CASE WHEN published_at IS NULL THEN 'unknownDate' WHEN CAST(published_at AS DATE) NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' THEN 'outsideRange' ELSE 'eligible' END AS eligibility FROM items"""))
def date_eligibility(spark, sf):
    day = lambda d: F.lit(d).cast("date")
    return admission.date_eligibility(inputs.items(spark, sf), day("2024-01-05"), day("2024-01-14")).select("item_id", "eligibility")


@registered("enrich_backlog", S.with_views("articles", """
    , f AS (SELECT article_id, CAST(item_id % 5 AS BIGINT) AS failures FROM articles WHERE item_id % 3 = 0)
    SELECT a.article_id FROM articles a LEFT JOIN embeddings e ON e.vec_id = a.item_id LEFT JOIN f ON f.article_id = a.article_id
    WHERE (a.mode <> 'model' OR e.vec_id IS NULL OR e.vec_id % 2 <> 0) AND coalesce(f.failures, 0) < 3"""))
def enrich_backlog(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.when(F.col("vec_id") % 2 == 0, "m1").otherwise("m2").alias("embedding_model"))
    base = inputs.article_index(spark, sf)
    failures = base.where("item_id % 3 = 0").select("article_id", (F.col("item_id") % 5).alias("failures"))
    return filters.enrich_backlog(base.join(vectors, "item_id", "left"), failures, model="m1", limit=None).select("article_id")


@registered("run_quota", """
    WITH k AS (SELECT *, user_id % 5 = 0 AS stored FROM events)
    SELECT event_id, event_type, CASE WHEN stored THEN 'duplicate' WHEN row_number() OVER (PARTITION BY event_type, stored ORDER BY ts, event_id) <= 80 THEN 'admitted' ELSE 'deferred' END AS outcome FROM k""")
def run_quota(spark, sf):
    events = inputs.table(spark, sf, "events")
    stored = events.where("user_id % 5 = 0").select("user_id")
    rows = events.select("event_id", "user_id", "event_type", "ts")
    return admission.run_quota(rows, stored, ["user_id"], ["event_type"], [F.col("ts"), F.col("event_id")], K.RUN_INSERT_CAP).select("event_id", "event_type", "outcome")


@registered("quota_admission", """
    SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 40 THEN 'admitted' ELSE 'deferred' END AS outcome FROM events""")
def quota_admission(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    return admission.quota_admission(events, ["day"], [F.col("ts"), F.col("event_id")], 40).select("event_id", "outcome")


@registered("distinct_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def distinct_first(spark, sf):
    return ranking.first_per_key(inputs.table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


# --- quality -------------------------------------------------------------------------------------------------

_RULES_SQL = [("title_length", "length(title) BETWEEN 1 AND 120"), ("text_length", "length(text) >= 80"), ("language_known", "language IN ('en', 'fr', 'de')"),
              ("dated", "published_at IS NOT NULL"), ("url_public", "starts_with(url, 'https://')"), ("digits", "NOT regexp_matches(title, '[0-9]')")]


@registered("validate_rows", S.with_views("items", f"""
    SELECT item_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in _RULES_SQL)}], lambda v: v IS NOT NULL), ',') AS violations FROM items"""))
def validate_rows(spark, sf):
    from newsweave.functions import url

    rules = {"title_length": F.length("title").between(1, 120), "text_length": F.length("text") >= 80, "language_known": F.col("language").isin("en", "fr", "de"),
             "dated": F.col("published_at").isNotNull(), "url_public": url.is_public_url(F.col("url")), "digits": ~F.col("title").rlike("[0-9]")}
    return quality.with_violations(inputs.items(spark, sf), rules).select("item_id", F.array_join("violations", ",").alias("violations"))


@registered("unique_violations", S.with_views("items", f"SELECT {S.canonical('url')} AS url, count(*) AS rows FROM items GROUP BY 1 HAVING count(*) > 1"))
def unique_violations(spark, sf):
    from newsweave.functions import url

    return quality.unique_violations(inputs.items(spark, sf).select(url.canonical_url(F.col("url")).alias("url")), ["url"])


@registered("orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def orphans(spark, sf):
    lines = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    orders = inputs.table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    return quality.orphans(lines, orders, "l_orderkey", "o_orderkey")
