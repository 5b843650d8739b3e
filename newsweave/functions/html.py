"""HTML functions as Column expressions: entities, tag stripping, meta tags, page parts, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import dates, text, url
from newsweave.functions.binding import let

# name = "value" or 'value' inside one tag
_ATTRIBUTE = r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_META_ATTRIBUTE = r"""([\w:-]+)\s*=\s*["']([^"']*)["']"""
_LD_JSON = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_NODE = "struct<`@type`:string,datePublished:string"
_LD_SCHEMA = f"array<{_NODE},`@graph`:array<{_NODE}>>>>"


def _code_point(code: Column) -> Column:
    """Character of a numeric reference body such as `65` or `x41`; empty when out of range."""
    digits = F.regexp_replace(code, "^[xX]?0*", "")
    number = F.when(code.rlike("^[xX]"), F.conv(F.right(F.concat(F.lit("0"), digits), F.lit(15)), 16, 10)).otherwise(
        F.right(digits, F.lit(18))).try_cast("long")
    in_range = lambda p: (p > 0) & (p <= 0x10FFFF) & (F.length(digits) <= 15)
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")
    return let(number, lambda p: F.when(in_range(p), char(p)).otherwise(F.lit("")))


def decode_entities(value: Column) -> Column:
    """Numeric references first, then the named ones; `&amp;` goes last so that nothing is decoded twice."""
    piece = lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(_code_point(F.substring_index(p, ";", 1)), F.regexp_replace(p, "^[^;]*;", "")))
    parts = lambda v: F.transform(F.split(v, r"(?i)&#(?=(?:x[0-9a-f]+|[0-9]+);)"), piece)
    out = let(value, lambda v: F.when(F.contains(v, F.lit("&#")), F.array_join(parts(v), "")).otherwise(v))
    for name, char in K.NAMED_ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def strip_html(value: Column) -> Column:
    """Readable text of an HTML fragment."""
    out = F.regexp_replace(value, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(K.DROPPED_BLOCKS)})\b[^>]*>.*?</\1>", " ")
    return text.collapse_ws(decode_entities(F.regexp_replace(out, "<[^>]+>", " ")))


def _attribute(tag: Column, name: str, pattern: str = _META_ATTRIBUTE) -> Column:
    """Value of the last attribute called `name` in a tag; null when absent."""
    pairs = F.regexp_extract_all(tag, F.lit(pattern), F.lit(0))
    same = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^([\w:-]+)", 1)) == name)
    value = F.try_element_at(same, F.lit(-1))
    return F.regexp_replace(F.regexp_replace(value, r"""^[\w:-]+\s*=\s*["']""", ""), """["']$""", "")


def meta_tags(html: Column) -> Column:
    """Meta tags of a page in order, as (property, name, content); missing attributes are null."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(*[_attribute(t, n).alias(n) for n in ("property", "name", "content")]))


def meta_value(tags: Column, key: str) -> Column:
    """Decoded content of the first tag whose property or name is `key`; empty when absent."""
    is_key = lambda t, n: F.coalesce(t[n] == key, F.lit(False))
    mine = F.filter(tags, lambda t: is_key(t, "property") | is_key(t, "name"))
    return F.coalesce(decode_entities(F.get(mine, F.lit(0))["content"]), F.lit(""))


def meta_content(html: Column, key: str) -> Column:
    return meta_value(meta_tags(html), key)


def _inner(html: Column, tag: str) -> Column:
    """Content of the first `tag` element; null when there is none (an empty element gives an empty text)."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return F.when(F.regexp_extract(html, pattern, 0) != "", F.regexp_extract(html, pattern, 1))


def _filled(value: Column) -> Column:
    """Null instead of an empty text."""
    return let(value, lambda v: F.when(v != "", v))


def page_title(html: Column, meta: Column | None = None) -> Column:
    meta = meta_tags(html) if meta is None else meta
    raw = F.coalesce(_filled(meta_value(meta, "og:title")), _filled(_inner(html, "h1")), _filled(_inner(html, "title")),
                     F.lit(K.UNTITLED))
    return strip_html(raw)


def page_body(html: Column, meta: Column | None = None) -> Column:
    meta = meta_tags(html) if meta is None else meta
    paragraphs = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>.*?</p>"), F.lit(0)), " ")
    raw = F.coalesce(_inner(html, "article"), _inner(html, "main"), paragraphs)
    return strip_html(F.coalesce(_filled(raw), meta_value(meta, "description")))


def structured_date(html: Column) -> Column:
    """`datePublished` of the first Article-like JSON-LD node (root, array element or @graph member)."""
    blocks = F.regexp_extract_all(html, F.lit(_LD_JSON), F.lit(1))

    def block_date(block: Column) -> Column:
        return let(F.from_json(block, _LD_SCHEMA), lambda roots: article_day(block, roots))

    def article_day(block: Column, roots: Column) -> Column:
        node = lambda n: F.struct(n["@type"].alias("kind"), n["datePublished"].alias("day"))
        graph = F.coalesce(F.get(roots, F.lit(0))["@graph"], F.array().cast(f"array<{_NODE}>>"))
        nodes = F.concat(
            F.transform(roots, node),
            F.when(F.ltrim(block).startswith("["), F.array().cast("array<struct<kind:string,day:string>>"))
            .otherwise(F.transform(graph, node)),
        )
        hit = F.filter(nodes, lambda n: n["kind"].rlike("Article|BlogPosting") & n["day"].isNotNull())
        return F.get(hit, F.lit(0))["day"]

    found = F.filter(F.transform(blocks, block_date), lambda d: d.isNotNull())
    return F.get(found, F.lit(0))


def page_date(html: Column, now: Column, meta: Column | None = None) -> Column:
    tags = meta_tags(html) if meta is None else meta
    written = let(tags, lambda m: F.coalesce(*[_filled(meta_value(m, k)) for k in K.META_DATE_KEYS]))
    raw = F.coalesce(written, structured_date(html))
    return dates.parse_date(raw, now)


def page_rejection(title: Column, body: Column) -> Column:
    return F.when(F.length(body) < K.MIN_PAGE_CHARS, "too_little_text").when(title.rlike(K.BOT_WALL), "browser_verification")


def advertised_links(html: Column, base: Column, mime: str = K.FEED_MIME, href: str = K.FEED_HREF,
                     excluded: str = K.FEED_EXCLUDED, limit: int | None = None) -> Column:
    """Public addresses advertised by link and anchor tags, distinct, in page order, without the page itself."""
    clean = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(clean, F.lit(r"(?i)<(?:link|a)\b[^>]*>"), F.lit(0))
    attr = lambda t, n: F.coalesce(decode_entities(_attribute(t, n, _ATTRIBUTE)), F.lit(""))
    parsed = F.transform(tags, lambda t: F.struct(attr(t, "href").alias("href"), attr(t, "type").alias("type"), attr(t, "title").alias("title")))
    chosen = F.filter(parsed, lambda a: (a["type"].rlike(mime) | a["href"].rlike(href))
                      & ~F.concat(a["href"], F.lit(" "), a["title"]).rlike(excluded))
    absolute = F.transform(chosen, lambda a: url.resolve_url(a["href"], base))
    links = F.array_distinct(F.filter(absolute, lambda u: url.is_public_url(u) & (u != base)))
    return F.slice(links, 1, limit) if limit else links
