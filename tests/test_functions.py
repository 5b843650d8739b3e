"""Unit assertions for the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsweave.functions import dates, html, text, url, vectors


def one(spark, expression, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expression(F.col("v")).alias("r")).first().r


def many(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_normalize(spark):
    got = many(spark, text.normalize, ["  Ｆｕｌｌ  Width Ａ ", "ﬁn", "Café", "A\tB", None])
    assert got == ["full width a", "fin", "café", "a b", None]


def test_tokens(spark):
    got = many(spark, text.tokens, ["The TCS news: 5 new-offices, x", "டிசிஎஸ் நிறுவனம் புதிய"])
    assert got == [["tcs", "new", "offices"], ["டிசிஎஸ்", "நிறுவனம்", "புதிய"]]


def test_detect_language(spark):
    df = spark.createDataFrame([("plain", "en"), ("செய்தி", "en"), ("ಸುದ್ದಿ", "en"), ("वार्ता", "mr"), ("वार्ता", "en"),
                                ("খবৰ", "as"), ("খবর", "en"), ("mixed हिन्दी தமிழ்", "en")], "t string, f string")
    got = [r.r for r in df.select(text.detect_language(F.col("t"), F.col("f")).alias("r")).collect()]
    assert got == ["en", "ta", "kn", "mr", "hi", "as", "bn", "ta"]


def test_fingerprint_ignores_case_and_spacing(spark):
    a, b = many(spark, text.fingerprint, ["Hello   World", "hello world "])
    assert a == b and len(a) == 64


def test_tone_and_event(spark):
    def tone(title, body):
        return spark.range(1).select(text.tone_label(F.lit(title), F.lit(body)).alias("r")).first().r

    assert tone("Company denies layoffs", "The company denies layoffs and has not announced reductions.") == "unclear"
    assert tone("Company reports layoffs", "The company announced layoffs in its support division.") == "negative"
    assert tone("Record profit", "despite a data breach") == "mixed"
    assert tone("Record profit", "in the year") == "positive"
    assert tone("nothing", "special") == "unclear"
    assert tone("élayoffs", "prelayoffs") == "negative"  # only the accented letter is no word character

    def event(t):
        return spark.range(1).select(text.event_label(F.lit(t), F.lit("")).alias("r")).first().r

    assert event("Hiring and lawsuit") == "Workforce"
    assert event("COLLABORATION widely") == "Partnership"
    assert event("விசாரணை") == "Regulatory"
    assert event("profits") == "Company update"


def test_baseline_struct(spark):
    r = spark.range(1).select(text.baseline_analysis(F.lit("T"), F.lit("Short. This sentence is certainly longer than thirty-five. X")).alias("a")).first().a
    assert r.summary == "This sentence is certainly longer than thirty-five."
    assert r.facts[0].quote == r.summary and r.impacts == [] and r.mode == "baseline" and r.model is None


def test_quote(spark):
    def ok(q, o):
        return spark.range(1).select(text.quote_supported(F.lit(q), F.lit(o)).alias("r")).first().r

    assert ok("The  Quick brown", "see the quick brown fox")
    assert not ok("quick", "see the quick brown fox")
    assert not ok("quick brown ox jumps", "see the quick brown fox")


@pytest.mark.parametrize("raw,want", [
    ("https://example.com/news/?id=2&utm_source=rss#top", "https://example.com/news?id=2"),
    ("HTTPS://Example.COM:443", "https://example.com/"),
    ("http://a.com:8080/x//", "http://a.com:8080/x"),
    ("https://a.com/?b=2&a=1&B=0&a=0", "https://a.com/?B=0&a=1&a=0&b=2"),
    ("https://a.com/p?UTM_X=1&fbclid=2&gclid=3&mc_eid=4", "https://a.com/p"),
    ("https://a.com/p?q=a%20b&flag", "https://a.com/p?flag=&q=a+b"),
    ("https://a.com/x/../y/./z", "https://a.com/y/z"),
    ("https://a.com/q?x=1=2", "https://a.com/q?x=1%3D2"),
    ("/relative", None), ("mailto:x@y.z", None),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonical_url, raw) == want


def test_url_rejection(spark):
    cases = {"https://example.com/a": None, "http://example.com": "not_https", "https://u:p@example.com": "credentials",
             "https://example.com:8443/": "port", "https://example.com:443/": None, "https://127.0.0.1/": "ip_literal",
             "https://[::1]/": "ip_literal", "https://localhost/": "no_dot", "https://a.internal/": "local_suffix",
             "https://x.nip.io/": "rebinding_suffix", "https://example.com./": None, "nonsense": "not_absolute",
             "https://example.com/" + "a" * 2000: "too_long"}
    assert many(spark, lambda c: url.url_rejection(c, 2000), list(cases)) == list(cases.values())


def test_public_ip(spark):
    cases = {"8.8.8.8": True, "10.0.0.1": False, "192.0.2.7": False, "192.0.1.7": True, "198.51.100.1": False,
             "198.51.101.1": True, "203.0.113.9": False, "203.0.114.9": True, "172.16.0.1": False, "172.32.0.1": True,
             "100.64.0.1": False, "100.128.0.1": True, "256.1.1.1": False, "1.2.3": False, "224.0.0.1": False,
             "2606:4700::1111": True, "2001:db8::1": False, "2002::1": False, "fe80::1": False, "3fff:1::": False,
             "3fff:1000::": True, "2001:4860::8888": True, "::1": False, "192.88.99.1": False, "192.88.98.1": True}
    assert many(spark, url.is_public_ip, list(cases)) == list(cases.values())


def test_resolve(spark):
    base = F.lit("https://a.com/d/e?x=1")
    hrefs = ["f", "/g", "//b.com/h", "?y=2", "../k", "https://c.com/", "#z"]
    got = many(spark, lambda c: url.resolve_url(c, base), hrefs)
    assert got == ["https://a.com/d/f", "https://a.com/g", "https://b.com/h", "https://a.com/d/e?y=2", "https://a.com/k",
                   "https://c.com/", "https://a.com/d/e?x=1#z"]


def test_parse_date(spark):
    now = F.lit("2026-09-10 00:00:00").cast("timestamp")
    values = ["", "nonsense", "2100-01-01", "2026-08-20", "Tue, 08 Sep 2026 10:00:00 GMT", "8 Sep 2026 10:00:00 +0530",
              "2026-08-20T01:02:03.500Z", "2026-08-20T01:02:03+05:30", "2026-08-20T01:02:03+0530", "1989-12-31",
              "September 3, 2026", "Wed, 9 Sep 2026 08:00 EST", "2026-09-11", "2026-09-12"]
    t = dt.datetime
    want = [None, None, None, t(2026, 8, 20), t(2026, 9, 8, 10), t(2026, 9, 8, 4, 30), t(2026, 8, 20, 1, 2, 3, 500000),
            t(2026, 8, 19, 19, 32, 3), t(2026, 8, 19, 19, 32, 3), None, t(2026, 9, 3), t(2026, 9, 9, 13), t(2026, 9, 11), None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.r for r in df.select("i", F.date_format(dates.parse_date(F.col("v"), now), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("r")).orderBy("i").collect()]
    assert got == [w and w.strftime("%Y-%m-%d %H:%M:%S.%f") for w in want]


def test_valid_day_and_range(spark):
    assert many(spark, dates.valid_day, ["2026-02-28", "2026-02-30", "2026-2-1", "x", None]) == [True, False, False, False, False]
    now = F.lit("2026-09-10 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("2026-09-01", "2026-09-10"), ("2026-09-05", "2026-09-01"), ("2026-09-01", "2026-09-11"),
                                ("2026-05-01", "2026-09-01"), ("2026-02-30", "2026-09-01")], "a string, b string")
    assert [r.r for r in df.select(dates.valid_range(F.col("a"), F.col("b"), now).alias("r")).collect()] == [True, False, False, False, False]


def test_entities_and_strip(spark):
    got = many(spark, html.decode_entities, ["&#65;&#x42;&amp;lt; &lt;b&gt; &bogus; &#0;&#1114112;&#38;lt; &#128512;&rsquo;", "a &# b"])
    assert got == ["AB&lt; <b> &bogus; < 😀’", "a &# b"]
    got = many(spark, html.strip_html, ["<p>a<script>x</script>b</p><![CDATA[c]]><NAV q>n</NAV> d&nbsp;e", "<header>h</footer>k</header>z"])
    assert got == ["a b c d e", "z"]


PAGE = """<html><head><title>T &amp; x</title><meta content='Meta title' property="og:title"><meta name="description" content="D"></head>
<body><h1>Head <b>ing</b></h1><article><p>Body text</p></article></body></html>"""


def test_page_parts(spark):
    assert one(spark, html.page_title, PAGE) == "Meta title"
    assert one(spark, html.page_title, PAGE.replace("og:title", "other")) == "Head ing"
    assert one(spark, html.page_title, "<title>T &amp; x</title>") == "T & x"
    assert one(spark, html.page_title, "<p>none") == "Untitled article"
    assert one(spark, html.page_body, PAGE) == "Body text"
    assert one(spark, html.page_body, "<main>M</main><p>x</p>") == "M"
    assert one(spark, html.page_body, "<p>x</p><div>y</div><P q>z</P>") == "x z"
    assert one(spark, html.page_body, "<meta name='description' content='only &quot;this&quot;'>") == 'only "this"'


def test_page_date(spark):
    now = F.lit("2026-09-10 00:00:00").cast("timestamp")
    f = lambda c: F.date_format(html.page_date(c, now), "yyyy-MM-dd")
    ld = '<script type="application/ld+json">%s</script>'
    cases = ['<meta property="article:published_time" content="2026-08-01T00:00:00Z">',
             ld % '{"@type":"NewsArticle","datePublished":"2026-08-20"}',
             ld % '[{"@type":"Org"},{"@type":["Thing","BlogPosting"],"datePublished":"2026-08-21"}]',
             ld % '{"@graph":[{"@type":"WebPage","datePublished":"2020-01-01"},{"@type":"Article","datePublished":"2026-08-22"}]}',
             ld % '{bad json' + ld % '{"@type":"Article","datePublished":"2026-08-23"}', "<p>none</p>"]
    assert many(spark, f, cases) == ["2026-08-01", "2026-08-20", "2026-08-21", "2026-08-22", "2026-08-23", None]


def test_links(spark):
    page = """<link rel="alternate" type="application/rss+xml" href="/feed.xml"><a href='https://b.com/rss'>r</a>
    <a href="/comments/feed">c</a><script><a href="/x.xml"></script><!-- <a href="/y.xml"> --><a href="http://insecure.com/rss">
    <a href="/rss?x=1&amp;y=2"><a href="/plain"><a href="/four.xml"><a href="/feed.xml">"""
    got = one(spark, lambda c: html.advertised_links(c, F.lit("https://a.com/"), limit=3), page)
    assert got == ["https://a.com/feed.xml", "https://b.com/rss", "https://a.com/rss?x=1&y=2"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [1.0]), ([], []), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [r.r for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("r")).collect()] == [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([([1.0],), ([],), (None,), ([float("nan")],), ([float("inf")],)], "v array<float>")
    assert [r.r for r in df.select(vectors.vector_valid(F.col("v")).alias("r")).collect()] == [True, False, False, False, False]


def test_hosts_have_one_spelling(spark):
    from newsweave.functions.hosts import ascii_host

    known = {"münchen.de": "xn--mnchen-3ya.de", "MÜNCHEN.de": "xn--mnchen-3ya.de", "例え。jp": "xn--r8jz45g.jp", "b%C3%BCcher.example": "xn--bcher-kva.example", "ｅｘａｍｐｌｅ.com": "example.com", "exa­mple.com": "example.com",
             "2130706433": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.01": "127.0.0.1", "1.2.3.": "1.2.0.3", "256.1": None, "1.2.3.4.5": None, "0x": "0.0.0.0", "1.2.3.08": None, "4294967296": None, "a b.com": None, "%2f.com": None, "a.b1": "a.b1", "1.com": "1.com", "%31.1": "1.0.0.1"}
    assert {h: ascii_host(h) for h in known} == known
    rows = [("http://MÜNCHEN.de:80/a/", "http://xn--mnchen-3ya.de/a"), ("https://user@2130706433:8443/x", "https://user@127.0.0.1:8443/x"), ("https://1.2.3.4.5/", None), ("https://a.example/%20", "https://a.example/%20"), (None, None), ("nonsense", None), ("https://[::1]/", "https://[::1]/")]
    got = spark.createDataFrame(rows, "u string, want string").select("u", "want", url.canonical_url(F.col("u")).alias("got"), url.url_rejection(F.col("u")).alias("why")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    odd = spark.createDataFrame([("https://0x7f.1/",), ("https://a.0x7F/",), ("https://news.example.com2/",)], "u string").select(url.url_rejection(F.col("u")).alias("why")).collect()
    assert [r.why for r in odd] == ["ip_literal", "ip_literal", None]
