"""RSS, Atom and RDF payloads to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import dates, html, text, url

# Entities stay undecoded through the XML parser: the ampersand travels as a private-use character.
_AMP = "\ue000"
_TEXT = "struct<_VALUE:string,_type:string>"
_ITEM = (
    "struct<title:{t},link:array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>,guid:struct<_VALUE:string,_isPermaLink:string>,"
    "`content:encoded`:{t},content:{t},description:{t},summary:{t},pubDate:string,published:string,`dc:date`:string,updated:string>"
).format(t=_TEXT)
FEED_SCHEMA = f"channel struct<title:string,item:array<{_ITEM}>>, entry array<{_ITEM}>, item array<{_ITEM}>, title string, _corrupt_record string"


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Add `feed` (parsed payload) and `rejection` to rows with an `xml` column."""
    parsed = F.from_xml(F.replace("xml", F.lit("&"), F.lit(_AMP)), FEED_SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "false"})
    rejection = (
        F.when(F.col("xml").rlike("(?i)<!DOCTYPE|<!ENTITY"), "document_type")
        .when(F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull(), "malformed")
        .when(~F.col("xml").rlike("(?i)<(rss|feed|rdf:RDF)[^a-z]"), "not_a_feed")
    )
    return payloads.withColumn("feed", parsed).withColumn("rejection", rejection)


def feed_items(payloads: DataFrame, now: Column, base: str = "url", language: str = "language",
               max_items: int | None = None, title_chars: int | None = None, text_chars: int | None = None) -> DataFrame:
    """Items of all accepted payloads (feed_id, url, language, xml): one row each, bad items dropped one by one."""
    entries = F.coalesce("feed.channel.item", "feed.entry", "feed.item")
    if max_items:
        entries = F.slice(entries, 1, max_items)
    keep = [c for c in payloads.columns if c != "xml"]
    rows = parse_feeds(payloads).where("rejection is null").select(*keep, F.posexplode(entries).alias("pos", "i"))
    plain = lambda c: F.coalesce(F.replace(c, F.lit(_AMP), F.lit("&")), F.lit(""))
    value = lambda name: F.nullif(plain(F.col(f"i.`{name}`._VALUE")), F.lit(""))
    stamp = lambda name: F.nullif(plain(F.col(f"i.`{name}`")), F.lit(""))
    usable = F.filter("i.link", lambda l: (l["_href"].isNull() & l["_VALUE"].isNotNull()) | l["_rel"].isNull() | (l["_rel"] == "alternate") | (l["_rel"] == ""))
    first = F.get(usable, F.lit(0))
    href = F.nullif(plain(F.coalesce(first["_href"], first["_VALUE"])), F.lit(""))
    target = html.decode_entities(F.coalesce(href, value("guid")))
    out = (
        rows.withColumn("link", url.resolve_url(target, F.col(base)))
        .withColumn("title", html.strip_html(F.coalesce(value("title"), F.lit(""))))
        .withColumn("body", html.strip_html(F.coalesce(value("content:encoded"), value("content"), value("description"), value("summary"), F.lit(""))))
        .withColumn("published_at", dates.parse_date(F.coalesce(stamp("pubDate"), stamp("published"), stamp("dc:date"), stamp("updated")), now))
        .where((F.col("title") != "") & url.is_public_url(F.col("link")))
    )
    if title_chars:
        out = out.withColumn("title", F.substring("title", 1, title_chars))
    if text_chars:
        out = out.withColumn("body", F.substring("body", 1, text_chars))
    others = [c for c in keep if c not in (base, language)]
    return out.select(
        *others, (F.col("pos") + 1).alias("pos"), url.canonical_url(F.col("link")).alias("url"), "title",
        F.coalesce(F.nullif("body", F.lit("")), "title").alias("text"), "published_at",
        text.detect_language(F.concat("title", "body"), F.col(language)).alias("language"), F.lit("feed-excerpt").alias("scope"))
