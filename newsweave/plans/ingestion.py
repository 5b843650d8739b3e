"""Registered queries: page and feed sources, admission, merging sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import url
from newsweave.operators import admission, merge
from newsweave.plans import check_sql as S
from newsweave.plans import inputs
from newsweave.plans.registry import registered
from newsweave.plans.scalars import _SQL_BODY, _SQL_TITLE
from newsweave.sources import feeds, pages, payloads, robots, snapshots


def _now():
    return F.lit("2024-12-31 00:00:00").cast("timestamp")


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- pages, feeds, robots -----------------------------------------------------------------------------------


@registered("page_extract", f"""
    WITH e AS (SELECT page_id, {S.canonical('url')} AS url, {_SQL_TITLE} AS title, {_SQL_BODY} AS text, regexp_extract(url, '/(en|fr|de|es)/', 1) AS language FROM pages)
    SELECT *, CASE WHEN length(text) < 80 THEN 'too_little_text' WHEN regexp_matches(title, {S.q(K.BOT_WALL)}) THEN 'browser_verification' END AS rejection FROM e""")
def page_extract(spark, sf):
    rows = inputs.pages(spark, sf)
    extracted = pages.extract_pages(rows, _now(), F.regexp_extract("url", "/(en|fr|de|es)/", 1))
    return extracted.select("page_id", "url", "title", "text", "language", "rejection")


def _xml(c):
    out = c if not isinstance(c, str) else F.col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _feed_payloads(spark, sf):
    """RSS payloads of fifty places each, so that a payload stays one bounded row; a document has its place by its id, and places without one hold an empty item."""
    i = inputs.items(spark, sf)
    day = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss")
    entry = F.concat(
        F.lit("<item><title>"), _xml("title"), F.lit("</title><link>"), _xml("url"), F.lit("</link>"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<description>"), _xml("text"), F.lit("</description>"))).otherwise(
            F.concat(F.lit("<description>short</description><content:encoded><![CDATA[<p>"), F.replace("text", F.lit("]]>"), F.lit("")), F.lit("</p>]]></content:encoded>"))),
        F.coalesce(F.concat(F.lit("<pubDate>"), day, F.lit(" GMT</pubDate>")), F.lit("")), F.lit("</item>"))
    head = '<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed</title>'
    placed = i.select(F.floor(F.col("item_id") / 50).alias("feed_id"), F.pmod("item_id", F.lit(50)).cast("int").alias("place"), "item_id", entry.alias("entry"))
    feeds_ = placed.groupBy("feed_id").agg(F.collect_list(F.struct("place", "item_id", "entry")).alias("entries"))
    free = F.array_except(F.sequence(F.lit(0), F.array_max("entries.place")), F.col("entries.place"))
    empty = F.transform(free, lambda p: F.struct(p.alias("place"), F.lit(None).cast("long").alias("item_id"), F.lit("<item><title></title></item>").alias("entry")))
    body = F.array_join(F.transform(F.array_sort(F.concat("entries", empty)), lambda s: s["entry"]), "")
    return feeds_.select("feed_id", F.lit("https://feeds.example.com/rss").alias("url"), F.lit("en").alias("language"), F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


@registered("feed_items", S.with_views("items", f"""
    SELECT item_id // 50 AS feed_id, CAST(item_id % 50 + 1 AS INTEGER) AS pos, {S.canonical('url')} AS url, {S.collapse('title')} AS title, {S.collapse('text')} AS text,
      strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM items"""))
def feed_items(spark, sf):
    rows = feeds.feed_items(_feed_payloads(spark, sf), _now())
    return rows.select("feed_id", "pos", "url", "title", "text", _ts("published_at").alias("published_at"))


@registered("load_items", f"""
    WITH s AS (SELECT page_id, {_SQL_BODY} AS body FROM pages)
    SELECT 'page-' || page_id AS source_id, CASE WHEN page_id % 5 = 0 THEN 0 WHEN page_id % 5 = 1 THEN 1 WHEN length(body) < 80 THEN 0 ELSE 1 END AS items,
      CASE WHEN page_id % 5 = 0 THEN 'no_readable_feed' WHEN page_id % 5 = 1 THEN NULL WHEN length(body) < 80 THEN 'too_little_text' END AS error FROM s""")
def load_items(spark, sf):
    p = inputs.pages(spark, sf)
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    home = F.concat(F.lit("https://site.example.com/"), F.col("page_id").cast("string"), F.lit("/"))
    kind = F.when(F.col("page_id") % 5 < 2, "discovery").otherwise("web")
    sources = p.select(name.alias("source_id"), kind.alias("kind"), home.alias("url"), F.lit("en").alias("language"))
    # pages of the second kind advertise a broken and a readable feed
    tag = F.when(F.col("page_id") % 5 == 1, F.lit('<link type="application/rss+xml" href="bad.xml"><link type="application/atom+xml" href="good.xml">')).otherwise("")
    bodies = p.select(home.alias("url"), F.concat(tag, "html").alias("body"))
    advertising = p.where("page_id % 5 = 1")
    atom = F.concat(F.lit("<feed><entry><title>Entry "), F.col("page_id").cast("string"), F.lit('</title><link href="https://site.example.com/entry"/></entry></feed>'))
    bodies = bodies.unionByName(advertising.select(F.concat(home, F.lit("bad.xml")).alias("url"), F.lit("<rss><channel>").alias("body"))).unionByName(
        advertising.select(F.concat(home, F.lit("good.xml")).alias("url"), atom.alias("body")))
    items, errors = payloads.load_items(sources, bodies, _now())
    counted = items.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("items"))
    return sources.select("source_id").join(counted, "source_id", "left").join(errors, "source_id", "left").select(
        "source_id", F.coalesce("items", F.lit(0)).alias("items"), "error")


@registered("robots_filter", f"""
    WITH h AS (SELECT page_id, {S.host('url')} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
    k AS (SELECT *, length(host) % 5 AS kind FROM h)
    SELECT page_id, CASE kind
      WHEN 0 THEN NOT (starts_with(path, '/en') AND NOT starts_with(path, '/en/1'))
      WHEN 1 THEN starts_with(path, '/fr') WHEN 2 THEN NOT regexp_matches(path, '^/.*[.]html$') WHEN 3 THEN true ELSE NOT contains(path, '?') END AS allowed FROM k""")
def robots_filter(spark, sf):
    p = inputs.pages(spark, sf)
    host = url.host(F.col("url"))
    texts = ["User-agent: *\nDisallow: /en\nAllow: /en/1 # first\n", "User-agent: *\nAllow: /\n\nUser-agent: newsweave\nDisallow: /\nAllow: /fr",
             "User-agent: other\nUser-agent: *\nDisallow: /*.html$\n", "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow:\n", "user-agent: *\r\nDisallow: /*?\r\n"]
    files = p.select(host.alias("host")).distinct().select("host", F.get(F.array(*[F.lit(t) for t in texts]), F.length("host") % 5).alias("robots"))
    return robots.robots_filter(p.select("page_id", "url"), files, "newsweave").select("page_id", "allowed")


# --- admission ------------------------------------------------------------------------------------------------

_DOC_PAGES_SQL = """pg AS (SELECT doc_id, 'c' || (doc_id % 20 + 1) AS company_id, n AS page_no, substr(text, CAST((n - 1) * 2000 + 1 AS BIGINT), 2000) AS body, (doc_id + n) % 4 <> 0 AS reviewed
    FROM (SELECT *, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 2000) AS BIGINT)))) AS n FROM documents)),
    pp AS (SELECT *, CASE WHEN page_no % 5 = 0 THEN 'scan' ELSE body END AS text FROM pg)"""


@registered("page_admission", S.with_views("watchlist", f"""
    , {_DOC_PAGES_SQL}, a AS (SELECT company_id, name AS alias FROM watchlist UNION ALL SELECT company_id, alias FROM watchlist),
    r AS (SELECT *, CASE WHEN length(text) >= 40 THEN 'pdf-text' ELSE 'vision-ocr' END AS method, CASE WHEN length(text) >= 40 THEN text ELSE body END AS b FROM pp),
    x AS (SELECT *, method = 'pdf-text' OR reviewed AS ok, regexp_replace({S.norm('b')}, {S.q(f"({K.WORD_RUN})")}, '<<\\1>>', 'g') AS t FROM r),
    m AS (SELECT DISTINCT doc_id, page_no FROM x JOIN a ON a.company_id = x.company_id AND contains(x.t, regexp_replace(a.alias, {S.q(f"({K.WORD_RUN})")}, '<<\\1>>', 'g'))),
    o AS (SELECT x.doc_id, x.ok, CASE WHEN NOT ok THEN 'awaiting_review' WHEN length(b) < 80 THEN 'too_short' WHEN m.doc_id IS NULL THEN 'entity_not_named' ELSE 'imported' END AS outcome
      FROM x LEFT JOIN m ON m.doc_id = x.doc_id AND m.page_no = x.page_no)
    SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE outcome = 'imported') AS articles, CASE WHEN bool_and(ok) THEN 'completed' ELSE 'review' END AS status FROM o GROUP BY doc_id"""))
def page_admission(spark, sf):
    numbered = inputs.documents(spark, sf).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("text") / 2000).cast("int")))).alias("page_no"))
    body = F.substring("text", (F.col("page_no") - 1) * 2000 + 1, F.lit(2000))
    rows = numbered.select(
        "doc_id", F.concat(F.lit("c"), (F.col("doc_id") % 20 + 1).cast("string")).alias("company_id"), "page_no", body.alias("ocr_text"),
        ((F.col("doc_id") + F.col("page_no")) % 4 != 0).alias("reviewed")).withColumn("text", F.when(F.col("page_no") % 5 == 0, "scan").otherwise(F.col("ocr_text")))
    return admission.document_status(admission.page_admission(rows, inputs.watchlist(spark, sf), ocr=True))


@registered("excerpt_import", S.with_views("items matches articles", f"""
    , r AS (SELECT item_id AS row_id, 'c' || (item_id % 3 + 1) AS company_id, CASE WHEN item_id % 19 = 0 THEN '' ELSE title END AS title, text,
        CASE WHEN item_id % 23 = 0 THEN 'http://insecure.example.com/' ELSE url END AS url FROM items),
    c AS (SELECT r.*, CASE WHEN starts_with(url, 'https://') THEN {S.canonical('url')} ELSE url END AS curl FROM r),
    s AS (SELECT DISTINCT company_id, url FROM articles WHERE item_id % 2 = 0)
    SELECT c.row_id, CASE WHEN NOT starts_with(c.url, 'https://') THEN 'bad_url' WHEN s.url IS NOT NULL THEN 'duplicate' WHEN length(c.title) = 0 THEN 'missing_title' WHEN length(c.text) < 80 THEN 'too_short'
      WHEN m.item_id IS NULL THEN 'entity_not_named' WHEN c.row_id <> min(c.row_id) OVER (PARTITION BY c.company_id, c.curl) THEN 'duplicate' ELSE 'imported' END AS outcome
    FROM c LEFT JOIN s ON s.company_id = c.company_id AND s.url = c.curl LEFT JOIN matches m ON m.item_id = c.row_id AND m.company_id = c.company_id"""))
def excerpt_import(spark, sf):
    rows = inputs.items(spark, sf).select(
        F.col("item_id").alias("row_id"), F.concat(F.lit("c"), (F.col("item_id") % 3 + 1).cast("string")).alias("company_id"),
        F.when(F.col("item_id") % 19 == 0, "").otherwise(F.col("title")).alias("title"), "text",
        F.when(F.col("item_id") % 23 == 0, "http://insecure.example.com/").otherwise(F.col("url")).alias("url"))
    existing = inputs.article_index(spark, sf).where("item_id % 2 = 0").select("company_id", "url")
    return admission.excerpt_import(rows, inputs.watchlist(spark, sf), existing).select("row_id", "outcome")


@registered("snapshot_admit", S.with_views("items matches sources", """
    , e AS (SELECT i.item_id * 100 + CAST(substr(w, 2) AS INT) AS entry_id, w AS company_id, i.source_id, i.item_id FROM items i, (SELECT unnest(['c1', 'c2', 'c3', 'c4']) AS w) x)
    SELECT e.entry_id, e.company_id, e.source_id FROM e JOIN matches m ON m.item_id = e.item_id AND m.company_id = e.company_id JOIN sources s ON s.source_id = e.source_id
    WHERE s.enabled AND s.source_id NOT IN ('src2', 'src4') AND e.company_id <> 'c4'"""))
def snapshot_admit(spark, sf):
    sources, companies = inputs.sources(spark, sf), inputs.watchlist(spark, sf)
    entries = inputs.items(spark, sf).withColumn("company_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(1, 5)]))).withColumn(
        "entry_id", F.col("item_id") * 100 + F.substring("company_id", 2, 9).cast("int"))
    moved = F.when(F.col("source_id") == "src4", F.lit("https://elsewhere.example.com/rss")).otherwise(F.col("url"))
    seed_sources = sources.where("source_id <> 'src2'").select("source_id", moved.alias("url"))
    seed_companies = companies.where("company_id <> 'c4'")
    return admission.snapshot_admit(entries, sources, companies, seed_sources, seed_companies).select("entry_id", "company_id", "source_id")


# --- merging sinks --------------------------------------------------------------------------------------------

@registered("merge_insert_ignore", """
    SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY l_orderkey""")
def merge_insert_ignore(spark, sf):
    lines = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    target = inputs.table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.insert_ignore(target, lines, ["l_orderkey"], [F.col("l_linenumber")])


@registered("merge_upsert", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '*' ELSE c_name END AS c_name, c_nationkey,
      CASE WHEN c_acctbal > 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal > 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0""")
def merge_upsert(spark, sf):
    customer = inputs.table(spark, sf, "customer")
    target = customer.where("c_mktsegment <> 'BUILDING'")
    updates = customer.where("c_acctbal > 0").withColumn("c_name", F.concat("c_name", F.lit("*"))).withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("c_mktsegment", F.lit("NEW"))
    return merge.upsert(target, updates, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@registered("merge_newer_only", S.with_views("sources runs", """
    , l AS (SELECT source_id, status, started_at FROM runs WHERE run_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, status DESC) = 1),
    b AS (SELECT source_id, status, CASE WHEN CAST(substr(source_id, 4) AS INT) % 2 = 0 THEN last_fetched_at - INTERVAL 20 DAY ELSE last_fetched_at END AS t FROM sources)
    SELECT b.source_id, CASE WHEN l.source_id IS NOT NULL AND (b.t IS NULL OR b.t <= l.started_at) THEN l.status ELSE b.status END AS status,
      strftime(CASE WHEN l.source_id IS NOT NULL AND (b.t IS NULL OR b.t <= l.started_at) THEN l.started_at ELSE b.t END, '%Y-%m-%d %H:%M:%S') AS last_fetched_at FROM b LEFT JOIN l ON l.source_id = b.source_id"""))
def merge_newer_only(spark, sf):
    old = F.col("last_fetched_at") - F.expr("INTERVAL 20 DAY")
    target = inputs.sources(spark, sf).select("source_id", "status", F.when(F.substring("source_id", 4, 9).cast("int") % 2 == 0, old).otherwise(F.col("last_fetched_at")).alias("last_fetched_at"))
    results = inputs.runs(spark, sf).where("run_id % 3 = 0").select("source_id", "status", F.col("started_at").alias("last_fetched_at"))
    return merge.update_newer(target, results, "source_id", "last_fetched_at", ["status"]).withColumn("last_fetched_at", _ts("last_fetched_at"))


@registered("seed_upgrade", """
    SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name || ' (edited)' ELSE s_name END AS s_name, s_nationkey FROM supplier""")
def seed_upgrade(spark, sf):
    supplier = inputs.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    existing = supplier.where("s_acctbal > 0").withColumn("s_name", F.concat("s_name", F.lit(" (edited)"))).drop("s_acctbal")
    return merge.seed_upgrade(existing, supplier.drop("s_acctbal"), ["s_suppkey", "s_name"], stored_version="1", version="2")


@registered("candidate_append", S.with_views("items", f"""
    , i AS (SELECT 'job-' || language AS job_id, {S.canonical('url')} AS url, source_id, item_id FROM items),
    q AS (SELECT DISTINCT job_id, url FROM i WHERE item_id % 5 = 0),
    f AS (SELECT i.job_id, i.url, min(source_id) AS source_id FROM i WHERE (job_id, url) NOT IN (SELECT (job_id, url) FROM q) GROUP BY ALL)
    SELECT f.job_id, f.url, f.source_id, TRUE AS accepted FROM f"""))
def candidate_append(spark, sf):
    rows = inputs.items(spark, sf).select(F.concat(F.lit("job-"), "language").alias("job_id"), url.canonical_url(F.col("url")).alias("url"), "source_id", "item_id")
    queued = rows.where("item_id % 5 = 0").select("job_id", "url").distinct()
    return merge.candidate_append(queued, rows.drop("item_id"))


# --- snapshots ------------------------------------------------------------------------------------------------

@registered("snapshot_build", S.with_views("items matches", """
    , p AS (SELECT i.language AS stream_id, m.item_id, m.company_id, i.source_id, length(i.text) AS n_chars, i.published_at FROM matches m JOIN items i ON i.item_id = m.item_id),
    k AS (SELECT * FROM p)
    SELECT stream_id, item_id, company_id, source_id, n_chars, FALSE AS truncated, count(*) OVER (PARTITION BY stream_id, source_id) AS matched FROM k"""))
def snapshot_build(spark, sf):
    entries, status = snapshots.build_snapshot(inputs.items(spark, sf).withColumn("stream_id", F.col("language")), inputs.watchlist(spark, sf))
    return entries.join(status, ["stream_id", "source_id"]).select(
        "stream_id", "item_id", "company_id", "source_id", F.length("text").cast("long").alias("n_chars"), "truncated", "matched")


@registered("manifest_retain", """
    WITH m AS (SELECT event_type AS stream_id, lpad(CAST(event_id // 2 * 2 AS VARCHAR), 13, '0') AS snapshot_id, min(sha256(props)) AS old_sha, count(*) FILTER (WHERE event_id % 2 = 1) AS again FROM events GROUP BY ALL),
    r AS (SELECT stream_id, snapshot_id, CASE WHEN again > 0 THEN 'replaced' ELSE old_sha END AS sha256, row_number() OVER (PARTITION BY stream_id ORDER BY snapshot_id DESC) <= 56 AS kept FROM m)
    SELECT * FROM r""")
def manifest_retain(spark, sf):
    e = inputs.table(spark, sf, "events").select(F.col("event_type").alias("stream_id"), F.lpad((F.floor(F.col("event_id") / 2) * 2).cast("string"), 13, "0").alias("snapshot_id"), "event_id", F.sha2("props", 256).alias("sha256"))
    manifest = e.groupBy("stream_id", "snapshot_id").agg(F.min("sha256").alias("sha256"))
    added = e.where("event_id % 2 = 1").select("stream_id", "snapshot_id", F.lit("replaced").alias("sha256"))
    return snapshots.manifest_retain(manifest, added)


@registered("manifest_verify", """
    SELECT doc_id AS snapshot_id, CASE CAST(doc_id % 6 AS INT) WHEN 1 THEN 'bad_hash' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'future' WHEN 4 THEN 'unlisted' ELSE 'ok' END AS status FROM documents""")
def manifest_verify(spark, sf):
    base, kind = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("doc_id") % 6
    docs = inputs.documents(spark, sf)
    finished = F.when(kind == 3, base + F.expr("INTERVAL 2 HOUR")).otherwise(base)
    manifest = docs.where(kind != 4).select(F.col("doc_id").alias("snapshot_id"), F.sha2("text", 256).alias("sha256"), F.when(kind == 2, base - F.expr("INTERVAL 1 HOUR")).otherwise(finished).alias("finished_at"))
    stored = docs.select(F.col("doc_id").alias("snapshot_id"), F.when(kind == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("payload"), finished.alias("finished_at"))
    return snapshots.manifest_verify(stored, manifest, base + F.expr("INTERVAL 30 SECOND")).select("snapshot_id", "status")


@registered("seal_roundtrip", """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 1 AND doc_id % 8 = 1 THEN NULL ELSE sha256(text) END AS opened_sha, length(text) >= 1000 AS long_text, length(text) >= 1000 AS is_smaller FROM documents""")
def seal_roundtrip(spark, sf):
    """Payloads compressed and sealed; every fourth is opened with a wrong key, every eighth has been tampered with."""
    key = F.unhex(F.sha2(F.col("source"), 256))
    sealed = inputs.documents(spark, sf).select("doc_id", "source", "text", snapshots.pack_and_seal(F.col("text"), key, "coverage").alias("sealed"))
    used = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.sha2(F.concat("source", F.lit("x")), 256))).otherwise(key)
    touched = F.when(F.col("doc_id") % 8 == 1, F.concat(F.expr("substring(sealed, 1, length(sealed) - 1)"), F.lit(b"\x00\x01"))).otherwise(F.col("sealed"))
    long_text = F.length("text") >= 1_000
    return sealed.select("doc_id", F.sha2(snapshots.unseal_and_unpack(touched, used, "coverage"), 256).alias("opened_sha"), long_text.alias("long_text"),
                         (long_text & (F.length("sealed") < F.octet_length("text"))).alias("is_smaller"))
