"""Feeds, robots files, payload routing and snapshots on hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from newsweave.plans import ingestion
from newsweave.sources import feeds, payloads, robots, snapshots

def now():
    return F.lit("2026-09-10 00:00:00").cast("timestamp")


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Ch</title>
<item><title>One &amp; only</title><link>https://news.example.com/a?utm_source=x</link><description>&lt;p&gt;Plain&lt;/p&gt; text</description><content:encoded><![CDATA[<p>Full &nbsp; text</p>]]></content:encoded><pubDate>Tue, 08 Sep 2026 10:00:00 GMT</pubDate></item>
<item><title type="html">Two</title><guid isPermaLink="true">/b</guid><dc:date>2026-09-01</dc:date></item>
<item><title>Bad link</title><link>http://insecure.example.com/</link></item>
<item><link>https://news.example.com/untitled</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title>Atom</title><link rel="self" href="https://n.example.com/self"/><link rel="alternate" href="https://n.example.com/alt"/><summary>S</summary><updated>2026-08-20T01:02:03Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>x</title></channel><item><title>Rdf</title><link>https://n.example.com/rdf</link></item></rdf:RDF>"""


def feed_df(spark, xmls):
    return spark.createDataFrame([(str(i), "https://news.example.com/feed", "en", x) for i, x in enumerate(xmls)],
                                 "feed_id string, url string, language string, xml string")


def test_feed_items(spark):
    rows = feeds.feed_items(feed_df(spark, [RSS, ATOM, RDF]), now()).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.pos, r.url, r.title, r.text) for r in rows] == [
        ("0", 1, "https://news.example.com/a", "One & only", "Full text"),
        ("0", 2, "https://news.example.com/b", "Two", "Two"),
        ("1", 1, "https://n.example.com/alt", "Atom", "S"),
        ("2", 1, "https://n.example.com/rdf", "Rdf", "Rdf"),
    ]
    assert rows[0].published_at == dt.datetime(2026, 9, 8, 10) and rows[1].published_at == dt.datetime(2026, 9, 1)
    assert rows[2].published_at == dt.datetime(2026, 8, 20, 1, 2, 3)


def test_feed_escaped_markup_stays_text(spark):
    xml = RSS.replace("<content:encoded><![CDATA[<p>Full &nbsp; text</p>]]></content:encoded>", "")
    assert feeds.feed_items(feed_df(spark, [xml]), now()).where("pos = 1").first().text == "<p>Plain</p> text"


def test_feed_rejections(spark):
    bad = feed_df(spark, ["<!DOCTYPE x><rss></rss>", "<rss><channel><item>", "<html><body/></html>", RSS])
    got = [r.rejection for r in feeds.parse_feeds(bad).orderBy("feed_id").collect()]
    assert got == ["document_type", "malformed", "not_a_feed", None]


def test_feed_item_limit(spark):
    many = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>https://e.example.com/{i}</link></item>" for i in range(200)) + "</channel></rss>"
    assert feeds.feed_items(feed_df(spark, [many]), now()).count() == 200
    assert feeds.feed_items(feed_df(spark, [many]), now(), max_items=150).count() == 150
    assert feeds.feed_items(feed_df(spark, [many]), now(), max_items=None).count() == 200


def test_robots(spark):
    files = {
        "longest.example.com": "User-agent: *\nDisallow: /private\nAllow: /private/open # comment",
        "specific.example.com": "User-agent: *\nDisallow: /\n\nUser-agent: newsweave\nAllow: /",
        "tie.example.com": "User-agent: *\nDisallow: /a\nAllow: /a",
        "end.example.com": "User-agent: *\nDisallow: /*.pdf$\nDisallow:",
        "two.example.com": "User-agent: other\nUser-agent: *\nDisallow: /x",
        "other.example.com": "User-agent: other\nDisallow: /",
    }
    f = spark.createDataFrame(list(files.items()), "host string, robots string")
    cases = {
        "https://longest.example.com/private/x": False, "https://longest.example.com/private/open/1": True, "https://longest.example.com/": True,
        "https://specific.example.com/any": True, "https://tie.example.com/a": True, "https://end.example.com/d/f.pdf": False,
        "https://end.example.com/d/f.pdf?x": True, "https://two.example.com/x1": False, "https://other.example.com/x": True,
        "https://none.example.com/": True,
    }
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.allowed for r in robots.robots_filter(urls, f, "newsweave").collect()}
    assert got == cases


def test_load_items(spark):
    sources = spark.createDataFrame([
        ("r", "rss", "https://news.example.com/feed", "en"), ("w", "web", "https://news.example.com/page", "en"),
        ("d", "discovery", "https://pub.example.com/", "en"), ("n", "discovery", "https://none.example.com/", "en"),
        ("m", "rss", "https://gone.example.com/", "en"), ("s", "web", "https://short.example.com/", "en")],
        "source_id string, kind string, url string, language string")
    page = "<h1>Head</h1><article>" + "long text " * 20 + "</article>"
    bodies = spark.createDataFrame([
        ("https://news.example.com/feed", RSS), ("https://news.example.com/page", page),
        ("https://pub.example.com/", "<a href='/broken/rss'>x</a><a href='/good/feed.xml'>y</a>"),
        ("https://pub.example.com/broken/rss", "<rss>"), ("https://pub.example.com/good/feed.xml", ATOM),
        ("https://none.example.com/", page), ("https://short.example.com/", "<article>short</article>")], "url string, body string")
    items, errors = payloads.load_items(sources, bodies, now())
    assert sorted((r.source_id, r.title) for r in items.collect()) == [("d", "Atom"), ("r", "One & only"), ("r", "Two"), ("w", "Head")]
    assert sorted((r.source_id, r.error) for r in errors.collect()) == [("m", "not_fetched"), ("n", "no_readable_feed"), ("s", "too_little_text")]


def test_seal(spark):
    key = F.unhex(F.lit("00" * 32))
    df = spark.createDataFrame([("payload",)], "p string").select(snapshots.seal(F.col("p"), key, "scope-1").alias("s"))
    r = df.select(snapshots.unseal(F.col("s"), key, "scope-1").alias("ok"), snapshots.unseal(F.col("s"), key, "scope-2").alias("aad"),
                  snapshots.unseal(F.col("s"), F.unhex(F.lit("01" * 32)), "scope-1").alias("key")).first()
    assert (r.ok, r.aad, r.key) == ("payload", None, None)


def test_manifest(spark):
    m = spark.createDataFrame([("a", f"{i:03}", "x") for i in range(5)], "stream_id string, snapshot_id string, sha256 string")
    added = spark.createDataFrame([("a", "004", "new"), ("a", "005", "y")], m.schema)
    got = {r.snapshot_id: (r.sha256, r.kept) for r in snapshots.manifest_retain(m, added, keep=3).collect()}
    assert got == {"000": ("x", False), "001": ("x", False), "002": ("x", False), "003": ("x", True), "004": ("new", True), "005": ("y", True)}


def test_feed_places_follow_the_ids(spark, tmp_path):
    ids = [3, 7, 8, 60, 99, 149, 1_000_020]
    rows = spark.createDataFrame([(i, f"Title {i}\nand its text", "en", "src1") for i in ids], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = ingestion.feed_items(spark, str(tmp_path)).select("feed_id", "pos", "title").collect()
    assert sorted(map(tuple, got)) == [(i // 50, i % 50 + 1, f"Title {i}") for i in ids]
