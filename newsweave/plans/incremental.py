"""Registered queries: jobs that add to stored tables step by step, compared with the result of one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.operators import story_index
from newsweave.plans import check_sql as S
from newsweave.plans import inputs
from newsweave.plans.registry import registered
from newsweave.session import scratch_path
from newsweave.sources import sync

SLICES = 5
PART_ITEMS = 100  # items of a snapshot part, so that a part stays one bounded row
SNAPSHOTS = 3
COUNTER_STEPS = 8


@registered("cluster_increment", S.with_views("roots", "SELECT article_id, cluster_id FROM roots"))
def cluster_increment(spark, sf):
    """The article table added in five slices by time of arrival; the stories are those of the whole table."""
    articles = inputs.articles(spark, sf)
    cuts = articles.select(F.expr(f"percentile_approx(unix_micros(fetched_at), array({', '.join(str(i / SLICES) for i in range(1, SLICES))}))").alias("cuts")).first().cuts or []
    part = sum((F.when(F.unix_micros("fetched_at") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    folder = scratch_path(spark, "stories")
    for n in range(SLICES):
        story_index.cluster_increment(spark, folder, articles.where(part == n), n)
    return story_index.stored_stories(spark, folder)


def _published(spark, sf):
    """Three snapshots of the items, each in parts, with manifest, header and results; every entry names one of two companies, and every third item comes again in the next snapshot."""
    items = inputs.items(spark, sf).select("item_id", "source_id", "title", "url", "text", "published_at", "language", "region")
    again = F.when(F.col("item_id") % 3 == 0, F.array((F.col("item_id") % SNAPSHOTS).cast("int"), ((F.col("item_id") + 1) % SNAPSHOTS).cast("int"))).otherwise(F.array((F.col("item_id") % SNAPSHOTS).cast("int")))
    entries = items.withColumn("n", F.explode(again)).withColumn("company_id", F.explode(F.array(F.lit("c1"), F.lit("c2")))).withColumn("part", F.floor(F.col("item_id") / (PART_ITEMS * SNAPSHOTS)).cast("int"))
    entry = F.struct("source_id", "company_id", "title", "url", "text", "published_at", "language", "region")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "company_id", entry.alias("entry")))), lambda x: x["entry"])
    finished = F.lit("2024-04-01 00:00:00").cast("timestamp") + F.expr("make_interval(0, 0, 0, n)")
    parts = inputs.stored(spark, sf, "snapshot_parts", lambda: entries.groupBy("n", "part").agg(F.to_json(ordered).alias("payload")).select(
        F.concat(F.lit("s"), F.col("n").cast("string")).alias("snapshot_id"), "part", "payload", (finished - F.expr("INTERVAL 1 HOUR")).alias("started_at"), finished.alias("finished_at"), (F.col("n") == 1).alias("truncated")))
    manifest = inputs.stored(spark, sf, "snapshot_manifest", lambda: parts.select("snapshot_id", "part", sync.part_hash(F.col("payload")).alias("sha256"), "finished_at"))
    results = inputs.stored(spark, sf, "snapshot_results", lambda: entries.groupBy(F.concat(F.lit("s"), F.col("n").cast("string")).alias("snapshot_id"), "source_id").agg(
        F.count(F.lit(1)).alias("scanned"), F.countDistinct("item_id").alias("matched")))
    failed = F.substring("source_id", 4, 9).cast("int") % 5 == 3
    return manifest, parts, results.withColumn("status", F.when(failed, "error").otherwise("healthy")).withColumn("error", F.when(failed, "HTTP 403"))


def _sources(spark, sf):
    """The source table as a synchronisation finds it: stored, since every snapshot reads it."""
    return inputs.stored(spark, sf, "sync_sources", lambda: inputs.sources(spark, sf))


@registered("snapshot_sync", S.with_views("items matches sources", f"""
    , e AS (SELECT 's' || n AS snapshot_id, n, i.item_id, i.source_id, w AS company_id, {S.canonical('i.url')} AS url
        FROM (SELECT *, unnest(CASE WHEN item_id % 3 = 0 THEN [item_id % {SNAPSHOTS}, (item_id + 1) % {SNAPSHOTS}] ELSE [item_id % {SNAPSHOTS}] END) AS n FROM items) i, (SELECT unnest(['c1', 'c2']) AS w) x),
    a AS (SELECT e.*, row_number() OVER (PARTITION BY e.company_id, e.url ORDER BY n, e.item_id) = 1 AS is_new FROM e JOIN matches m ON m.item_id = e.item_id AND m.company_id = e.company_id
        JOIN sources s ON s.source_id = e.source_id WHERE s.enabled AND s.source_id <> 'src2'),
    c AS (SELECT snapshot_id, source_id, count(*) FILTER (WHERE is_new) AS inserted, count(*) FILTER (WHERE NOT is_new) AS duplicates FROM a GROUP BY ALL),
    r AS (SELECT e.snapshot_id, e.n, e.source_id, count(*) AS scanned, count(DISTINCT item_id) AS matched, CAST(substr(e.source_id, 4) AS INT) % 5 = 3 AS failed FROM e JOIN sources s ON s.source_id = e.source_id AND s.enabled GROUP BY ALL)
    SELECT r.snapshot_id, r.source_id, CASE WHEN failed THEN 'error' WHEN n = 1 THEN 'partial' ELSE 'success' END AS status, scanned, matched, coalesce(inserted, 0) AS inserted, coalesce(duplicates, 0) AS duplicates,
      CASE WHEN (SELECT any_value(failed) FROM r q WHERE q.source_id = r.source_id) THEN 'error' ELSE 'healthy' END AS source_status,
      strftime(TIMESTAMP '2024-04-01' + to_days(CAST((SELECT max(n) FROM r q WHERE q.source_id = r.source_id) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS last_fetched_at
    FROM r LEFT JOIN c USING (snapshot_id, source_id)"""))
def snapshot_sync(spark, sf):
    """Run rows and source states after all snapshots; the job is stopped after its first step and started again."""
    sources, companies = _sources(spark, sf), inputs.watchlist(spark, sf)
    tables = (*_published(spark, sf), sources, companies, sources.where("source_id <> 'src2'").select("source_id", "url"), companies)
    folder, now = scratch_path(spark, "sync"), F.lit("2024-12-31 00:00:00").cast("timestamp")
    rules = {"now": now, "parts_per_step": 20, "event_rules": inputs.EVENT_RULES, "tone_rules": inputs.TONE_RULES}
    sync.snapshot_sync(spark, folder, *tables, max_steps=1, **rules)
    store = sync.snapshot_sync(spark, folder, *tables, **rules)
    state = store.source_state(sources).select("source_id", F.col("status").alias("source_status"), F.date_format("last_fetched_at", "yyyy-MM-dd HH:mm:ss").alias("last_fetched_at"))
    return store.runs().select("snapshot_id", "source_id", "status", "scanned", "matched", "inserted", "duplicates").join(state, "source_id")


@registered("sync_backlog", S.with_views("items sources", f"""
    , e AS (SELECT n, item_id // {PART_ITEMS * SNAPSHOTS} AS part FROM (SELECT *, unnest(CASE WHEN item_id % 3 = 0 THEN [item_id % {SNAPSHOTS}, (item_id + 1) % {SNAPSHOTS}] ELSE [item_id % {SNAPSHOTS}] END) AS n FROM items)),
    l AS (SELECT count(DISTINCT part) AS n_parts FROM e WHERE n = 0), c AS (SELECT CASE WHEN n_parts > 2 THEN 0 ELSE 1 END AS n, CASE WHEN n_parts > 2 THEN 2 ELSE 0 END AS first FROM l)
    SELECT any_value({SNAPSHOTS} - c.n)::BIGINT AS pending_snapshots, count(DISTINCT part) AS pending_parts, 2 * count(*) AS pending_records,
      (SELECT count(*) FROM sources WHERE enabled AND CASE WHEN (SELECT n FROM c) = 1 AND source_id IN (SELECT source_id FROM items WHERE item_id % 3 = 0) THEN CAST(substr(source_id, 4) AS INT) % 5 = 3 ELSE status = 'error' END) AS failed_sources
    FROM e, c WHERE e.n = c.n AND part >= c.first"""))
def sync_backlog(spark, sf):
    """What waits after the first step of the synchronisation, which takes two parts."""
    sources, companies = _sources(spark, sf), inputs.watchlist(spark, sf)
    manifest, parts, results = _published(spark, sf)
    store = sync.snapshot_sync(spark, scratch_path(spark, "sync"), manifest, parts, results, sources, companies, sources.where("source_id <> 'src2'").select("source_id", "url"), companies,
                               max_steps=1, now=F.lit("2024-12-31 00:00:00").cast("timestamp"), parts_per_step=2, event_rules=inputs.EVENT_RULES, tone_rules=inputs.TONE_RULES)
    return sync.backlog(store, manifest, parts, sources).drop("last_finished_at")


@registered("counter_steps", """
    SELECT 'src' || (user_id % 20) AS source_id, count(*) FILTER (WHERE event_type <> 'view') AS inserted, count(*) FILTER (WHERE event_type = 'view') AS duplicates FROM events GROUP BY ALL""")
def counter_steps(spark, sf):
    """Counter maps of eight steps, the fifth delivered twice, merged into one: equal to counting at once."""
    rows = inputs.table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), (F.col("event_type") != "view").alias("is_new"), (F.col("event_id") % COUNTER_STEPS).cast("int").alias("step"))
    steps = sync.count_outcomes(rows, ["step"])
    log = steps.unionByName(steps.where("step = 5"))
    return sync.total_counters(log, "step")
