"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import dates, html, text, url, vectors
from newsweave.plans import check_sql as S
from newsweave.plans import inputs
from newsweave.plans.registry import registered
from newsweave.sources import pages as page_source
from newsweave.sources import tables


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@registered("text_normalize", f"SELECT doc_id, sha256({S.norm('text')}) AS normalized_sha, length({S.norm('text')}) AS n_chars FROM documents")
def text_normalize(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.normalize(F.col("text")).alias("n")).select(
        "doc_id", F.sha2("n", 256).alias("normalized_sha"), F.length("n").cast("long").alias("n_chars"))


@registered("text_tokens", f"""
    WITH t AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, sha256(array_to_string(w, ' ')) AS tokens_sha FROM t""")
def text_tokens(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.sha2(F.array_join("w", " "), 256).alias("tokens_sha"))


_SAMPLES = (("ta", "செய்தி"), ("kn", "ಸುದ್ದಿ"), ("te", "వార్త"), ("ml", "വാർത്ത"), ("gu", "સમાચાર"), ("pa", "ਖ਼ਬਰ"), ("or", "ଖବର"), ("bn", "খবর"), ("hi", "समाचार"))


@registered("lang_detect", f"""
    WITH d AS (SELECT doc_id, lang, text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || ({S.sql_list(w for _, w in _SAMPLES)})[CAST(doc_id % 9 AS INT) + 1] END AS t,
        CASE WHEN doc_id % 5 = 0 THEN 'mr' WHEN doc_id % 5 = 1 THEN 'as' ELSE lang END AS fallback FROM documents)
    SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, {S.q(p)}) THEN " + (f"CASE WHEN fallback = '{shared}' THEN '{shared}' ELSE '{code}' END" if shared else f"'{code}'") for p, code, shared in K.SCRIPT_LANGUAGES)}
      ELSE fallback END AS language FROM d""")
def lang_detect(spark, sf):
    word = F.get(F.array(*[F.lit(w) for _, w in _SAMPLES]), (F.col("doc_id") % 9).cast("int"))
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), word)))
    fallback = F.when(F.col("doc_id") % 5 == 0, "mr").when(F.col("doc_id") % 5 == 1, "as").otherwise(F.col("lang"))
    return inputs.documents(spark, sf).select("doc_id", text.detect_language(body, fallback).alias("language"))


@registered("content_hash", f"SELECT doc_id, sha256({S.norm('text')}) AS content_hash FROM documents")
def content_hash(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.fingerprint(F.col("text")).alias("content_hash"))


@registered("jaccard_pairs", f"""
    WITH t AS (SELECT doc_id, list_distinct({S.tokens('text')}) AS w FROM documents)
    SELECT a.doc_id, round({S.jaccard('a.w', 'b.w')}, 6) AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, sf):
    sets = inputs.documents(spark, sf).select("doc_id", text.token_set(F.col("text")).alias("w"))
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return sets.join(following, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("w2")), 6).alias("similarity"))


@registered("lead_sentence", f"SELECT doc_id, {S.sentence('text')} AS sentence FROM documents")
def lead_sentence(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.lead_sentence(F.col("text")).alias("sentence"))


@registered("event_label", f"SELECT doc_id, {S.event('text')} AS label FROM documents")
def event_label(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.classify(F.col("text"), inputs.EVENT_RULES, K.DEFAULT_EVENT).alias("label"))


@registered("tone_label", f"SELECT doc_id, {S.tone('chr(10) || text')} AS tone FROM documents")
def tone_label(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", text.tone_label(F.lit(""), F.col("text"), *inputs.TONE_RULES).alias("tone"))


@registered("baseline_analysis", S.with_views("items", f"""
    SELECT item_id, {S.event('title || chr(10) || text')} AS event_type, {S.tone('title || chr(10) || text')} AS sentiment,
      coalesce(nullif({S.sentence('text')}, ''), title) AS summary,
      coalesce(nullif({S.sentence('text')}, ''), title) AS quote, CAST(0 AS BIGINT) AS impacts, 'baseline' AS mode FROM items"""))
def baseline_analysis(spark, sf):
    a = text.baseline_analysis(F.col("title"), F.col("text"), inputs.EVENT_RULES, inputs.TONE_RULES)
    return inputs.items(spark, sf).select("item_id", a.alias("a")).select(
        "item_id", "a.event_type", "a.sentiment", "a.summary", F.col("a.facts")[0]["quote"].alias("quote"),
        F.size("a.impacts").cast("long").alias("impacts"), "a.mode")


@registered("quote_supported", f"""
    WITH d AS (SELECT doc_id, text, replace(substr(text, 5, 12 + CAST(doc_id % 40 AS INT)), ' ', '  ') || CASE WHEN doc_id % 7 = 0 THEN 'zzq' ELSE '' END AS quote FROM documents)
    SELECT doc_id, length({S.trim_ws('quote')}) >= 12 AND contains({S.norm('text')}, {S.norm('quote')}) AS supported FROM d""")
def quote_supported(spark, sf):
    quote = F.concat(F.replace(F.substring("text", F.lit(5), (12 + F.col("doc_id") % 40).cast("int")), F.lit(" "), F.lit("  ")), F.when(F.col("doc_id") % 7 == 0, "zzq").otherwise(""))
    return inputs.documents(spark, sf).select("doc_id", "text", quote.alias("quote")).select(
        "doc_id", text.quote_supported(F.col("quote"), F.col("text")).alias("supported"))


# --- HTML -------------------------------------------------------------------------------------------------

@registered("html_entities", f"SELECT page_id, {S.entities('html')} AS decoded FROM pages")
def html_entities(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html.decode_entities(F.col("html")).alias("decoded"))


@registered("html_strip", f"SELECT page_id, {S.strip_html('html')} AS plain FROM pages")
def html_strip(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html.strip_html(F.col("html")).alias("plain"))


# meta tags are added to the given pages in both attribute orders
_META_SQL = "replace(html, '<meta charset=\"utf-8\">', CASE WHEN page_id % 2 = 0 THEN '<meta content=\"' || page_id || ' &amp; co\" name=\"description\">' ELSE '<META property=''og:title'' content=''T' || page_id || '''>' END)"


def _with_meta(pages):
    even = F.concat(F.lit('<meta content="'), F.col("page_id").cast("string"), F.lit(' &amp; co" name="description">'))
    odd = F.concat(F.lit("<META property='og:title' content='T"), F.col("page_id").cast("string"), F.lit("'>"))
    tag = F.when(F.col("page_id") % 2 == 0, even).otherwise(odd)
    return pages.withColumn("html", F.replace("html", F.lit('<meta charset="utf-8">'), tag))


@registered("html_meta", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id || ' & co' ELSE '' END AS description,
    CASE WHEN page_id % 2 = 1 THEN 'T' || page_id ELSE '' END AS og_title FROM pages""")
def html_meta(spark, sf):
    return _with_meta(inputs.pages(spark, sf)).select("page_id", html.meta_content(F.col("html"), "description").alias("description"),
                                     html.meta_content(F.col("html"), "og:title").alias("og_title"))


def _sql_inner(x: str, tag: str) -> str:
    pattern = S.q(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")
    return f"CASE WHEN regexp_matches({x}, {pattern}) THEN regexp_extract({x}, {pattern}, 1) END"


_SQL_TITLE = S.strip_html(f"coalesce(nullif({_sql_inner('html', 'h1')}, ''), nullif({_sql_inner('html', 'title')}, ''), '{K.UNTITLED}')")
_SQL_BODY = S.strip_html(f"coalesce({_sql_inner('html', 'article')}, {_sql_inner('html', 'main')}, array_to_string(regexp_extract_all(html, '(?is)<p\\b[^>]*>.*?</p>'), ' '))")


@registered("page_title", f"SELECT page_id, {_SQL_TITLE} AS title FROM pages")
def page_title(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html.page_title(F.col("html")).alias("title"))


@registered("page_body", f"SELECT page_id, {_SQL_BODY} AS body FROM pages")
def page_body(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html.page_body(F.col("html")).alias("body"))


@registered("page_date", """
    SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(page_id % 300 AS INT), '%Y-%m-%d') END AS published_day
    FROM pages""")
def page_date(spark, sf):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    ld = lambda before, after: F.concat(F.lit('<script type="application/ld+json">' + before), day, F.lit(after + "</script>"))
    kind = F.col("page_id") % 4
    tag = (
        F.when(kind == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T00:00:00Z">')))
        .when(kind == 1, ld('{"@type":"NewsArticle","datePublished":"', '"}'))
        .when(kind == 2, F.concat(F.lit('<script type="application/ld+json">{broken</script>'), ld('{"@graph":[{"@type":"WebPage"},{"@type":["Article"],"datePublished":"', '"}]}')))
        .otherwise("")
    )
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return inputs.pages(spark, sf).select("page_id", F.concat(tag, F.col("html")).alias("html")).select(
        "page_id", F.date_format(html.page_date(F.col("html"), now), "yyyy-MM-dd").alias("published_day"))


@registered("page_links", r"""
    WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h
      FROM pages),
    t AS (SELECT page_id, url, generate_subscripts(l, 1) AS n, unnest(l) AS href FROM (
      SELECT page_id, url, regexp_extract_all(h, '<a href="([^"]*)"', 1) AS l FROM p)),
    r AS (SELECT page_id, n, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link FROM t WHERE regexp_matches(href, '^/[a-zA-Z]') AND starts_with(url, 'https://')),
    d AS (SELECT page_id, link, min(n) AS n FROM r GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS pos, link FROM d""")
def page_links(spark, sf):
    found = page_source.discovered_links(inputs.pages(spark, sf).select("page_id", "url", "html"), href="^/[a-zA-Z]")
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


# --- URL, address and date ------------------------------------------------------------------------------------

@registered("url_canonical", S.with_views("items", f"""
    SELECT page_id, {S.canonical('url')} AS canonical FROM pages
    UNION ALL SELECT -1 - item_id AS page_id, {S.canonical('url')} AS canonical FROM items
    UNION ALL SELECT -1000000000 - page_id, 'https://h.example.com/%E0%AE%9A%C3%A9%F0%9F%98%80/a%20b/' || page_id FROM pages, (VALUES (1), (2)) spellings
    UNION ALL SELECT -2000000000 - page_id, 'https://xn--bcher-kva.example.com/' || page_id FROM pages, (VALUES (1), (2), (3)) spellings
    UNION ALL SELECT -3000000000 - page_id, 'https://8.8.8.' || (page_id % 256) || '/x' FROM pages, (VALUES (1), (2), (3)) spellings"""))
def url_canonical(spark, sf):
    urls = inputs.pages(spark, sf).select("page_id", "url").unionByName(inputs.items(spark, sf).select((-1 - F.col("item_id")).alias("page_id"), "url"))
    # both spellings of a path in other letters are one address
    spelled = [F.concat(F.lit(f"https://H.example.com/{p}/"), F.col("page_id").cast("string")) for p in ("\u0b9a\u00e9\U0001f600/a b", "%E0%AE%9A%C3%A9%F0%9F%98%80/a%20b")]
    both = inputs.pages(spark, sf).select((-1_000_000_000 - F.col("page_id")).alias("page_id"), F.explode(F.array(*spelled)).alias("url"))
    # so are both spellings of a host, and the ways to write a numeric one
    p, last = inputs.pages(spark, sf), F.col("page_id") % 256
    hosts = [F.concat(F.lit(f"https://{h}.Example.com/"), F.col("page_id").cast("string")) for h in ("b\u00fccher", "xn--bcher-kva", "B%C3%9Ccher")]
    named = p.select((-2_000_000_000 - F.col("page_id")).alias("page_id"), F.explode(F.array(*hosts)).alias("url"))
    numbers = [F.concat(F.lit("https://0x8.010.8."), last.cast("string"), F.lit("/x")), F.concat(F.lit("https://8.8."), (2_048 + last).cast("string"), F.lit("/x")), F.concat(F.lit("https://"), (134_744_064 + last).cast("string"), F.lit("/x/"))]
    numeric = p.select((-3_000_000_000 - F.col("page_id")).alias("page_id"), F.explode(F.array(*numbers)).alias("url"))
    return urls.unionByName(both).unionByName(named).unionByName(numeric).select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@registered("url_host", f"SELECT page_id, {S.host('url')} AS host, regexp_replace({S.host('url')}, '^(www|feeds?|rss)[.]', '') AS publisher_host FROM pages")
def url_host(spark, sf):
    return inputs.pages(spark, sf).select("page_id", url.host(F.col("url")).alias("host"), url.publisher_host(F.col("url")).alias("publisher_host"))


_URL_VARIANT_SQL = """CASE CAST(page_id % 10 AS INT) WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN replace(url, '://', '://user:pw@')
    WHEN 3 THEN regexp_replace(url, '^https?(://[^/]*)', 'https\\1:8443') WHEN 4 THEN 'https://10.0.0.' || page_id || '/x' WHEN 5 THEN 'https://localhost/' || page_id
    WHEN 6 THEN 'https://x' || page_id || '.internal/' WHEN 7 THEN 'https://h' || page_id || '.nip.io/' WHEN 8 THEN regexp_extract(url, '[^:]*$') ELSE regexp_replace(url, '^https?(://[^/]*)', 'https\\1:443') END"""


@registered("url_admissible", f"""
    WITH u AS (SELECT page_id, {_URL_VARIANT_SQL} AS u FROM pages),
    h AS (SELECT *, regexp_extract(u, '://(?:[^@/]*@)?([^/:?#]*)', 1) AS h FROM u)
    SELECT page_id, CASE WHEN NOT contains(u, '://') THEN 'not_absolute' WHEN NOT starts_with(u, 'https://') THEN 'not_https' WHEN contains(u, '@') THEN 'credentials'
      WHEN contains(u, ':8443') THEN 'port' WHEN regexp_matches(h, '^[0-9.]+$') THEN 'ip_literal' WHEN NOT contains(h, '.') THEN 'no_dot'
      WHEN regexp_matches(h, {S.q(K.LOCAL_SUFFIX)}) THEN 'local_suffix' WHEN regexp_matches(h, {S.q(K.REBINDING_HOST)}) THEN 'rebinding_suffix' END AS rejection FROM h""")
def url_admissible(spark, sf):
    u, s = F.col("url"), F.col("page_id").cast("string")
    options = [u, F.regexp_replace(u, "^http://", "https://"), F.replace(u, F.lit("://"), F.lit("://user:pw@")), F.regexp_replace(u, "^https?(://[^/]*)", "https$1:8443"),
               F.concat(F.lit("https://10.0.0."), s, F.lit("/x")), F.concat(F.lit("https://localhost/"), s), F.concat(F.lit("https://x"), s, F.lit(".internal/")),
               F.concat(F.lit("https://h"), s, F.lit(".nip.io/")), F.regexp_extract(u, "[^:]*$", 0), F.regexp_replace(u, "^https?(://[^/]*)", "https$1:443")]
    variant = F.get(F.array(*options), (F.col("page_id") % 10).cast("int"))
    return inputs.pages(spark, sf).select("page_id", variant.alias("u")).select("page_id", url.url_rejection(F.col("u"), K.MAX_URL_CHARS).alias("rejection"))


def _sql_number(ip: str) -> str:
    return " + ".join(f"CAST(split_part('{ip}', '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))


_SPECIAL_SQL = " OR ".join(f"n BETWEEN {_sql_number(a)} AND {_sql_number(b)}" for a, b in K.SPECIAL_IPV4)


@registered("ip_public", f"""
    WITH n AS (SELECT event_id, CAST((event_id * 2654435761 + 97) % 4294967296 AS BIGINT) AS n FROM events)
    SELECT event_id, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip, NOT ({_SPECIAL_SQL}) AS is_public FROM n""")
def ip_public(spark, sf):
    n = F.expr("(event_id * 2654435761 + 97) % 4294967296")
    part = lambda d: F.expr(f"cast(n div {d} % 256 as string)")
    rows = inputs.table(spark, sf, "events").select("event_id", n.alias("n")).select("event_id", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("ip"))
    return rows.select("event_id", "ip", url.is_public_ip(F.col("ip")).alias("is_public"))


@registered("date_parse", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(date_trunc('second', o_orderdate) + INTERVAL 1 SECOND * CASE WHEN o_orderkey % 7 IN (2, 5) THEN 0 ELSE CAST(o_orderkey % 86400 AS INT) END, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""")
def date_parse(spark, sf):
    ts = F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400)").cast("timestamp")
    f = lambda p: F.date_format(ts, p)
    shapes = [F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.concat(f("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), f("yyyy-MM-dd"),
              F.concat(F.date_format(ts + F.expr("INTERVAL 330 MINUTE"), "d MMM yyyy HH:mm:ss"), F.lit(" +0530")),
              F.concat(F.date_format(ts - F.expr("INTERVAL 5 HOUR"), "EEEE, d MMM yyyy HH:mm:ss"), F.lit(" EST")), f("MMMM d, yyyy"), F.concat(F.lit("on "), f("yyyy"))]
    written = F.get(F.array(*shapes), (F.col("o_orderkey") % 7).cast("int"))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return inputs.table(spark, sf, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", _ts(dates.parse_date(F.col("w"), now)).alias("parsed"))


@registered("date_valid", """
    WITH d AS (SELECT o_orderkey, (2020 + o_orderkey % 5) || '-' || lpad(CAST(1 + o_orderkey % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + o_orderkey % 31 AS VARCHAR), CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 2 END, '0') AS day FROM orders)
    SELECT o_orderkey, day, length(day) = 10 AND try_strptime(day, '%Y-%m-%d') IS NOT NULL AS valid FROM d""")
def date_valid(spark, sf):
    day = F.expr("concat(2020 + o_orderkey % 5, '-', lpad(cast(1 + o_orderkey % 13 as string), 2, '0'), '-', lpad(cast(1 + o_orderkey % 31 as string), case when o_orderkey % 50 = 0 then 1 else 2 end, '0'))")
    return inputs.table(spark, sf, "orders").select("o_orderkey", day.alias("day")).withColumn("valid", dates.valid_day(F.col("day")))


@registered("local_date", """
    SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%-d %b %Y, %H:%M') AS shown_time,
      CASE WHEN event_id % 9 = 0 THEN 'Date unknown' ELSE strftime(ts + INTERVAL 330 MINUTE, '%-d %b %Y') END AS shown_day FROM events""")
def local_date(spark, sf):
    known = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp"))
    return inputs.table(spark, sf, "events").select("event_id", dates.local_date(F.col("ts").cast("timestamp"), with_time=True).alias("shown_time"),
                                                    dates.local_date(known).alias("shown_day"))


# --- vectors and JSON -----------------------------------------------------------------------------------------

@registered("cosine_pairs", """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    e = inputs.table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@registered("vector_valid", "SELECT vec_id, vec_id % 4 <> 1 AND vec_id % 4 <> 2 AS valid FROM embeddings")
def vector_valid(spark, sf):
    bad = F.when(F.col("vec_id") % 8 == 1, float("nan")).otherwise(float("inf")).cast("float")
    v = F.when(F.col("vec_id") % 4 == 1, F.concat("embedding", F.array(bad))).when(F.col("vec_id") % 4 == 2, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return inputs.table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", vectors.vector_valid(F.col("v")).alias("valid"))


@registered("json_roundtrip_props", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events""")
def json_roundtrip_props(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", tables.decode_json(F.col("props"), "k bigint").alias("p")).select(
        "event_id", F.col("p.k").alias("k"), tables.encode_json(F.col("p")).alias("encoded"))
