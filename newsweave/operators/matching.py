"""Joins that find what a text or an address refers to: entity aliases, publishers, dimension look-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text, url
from newsweave.functions.binding import let
from newsweave.functions.hosts import with_ascii_host
from newsweave.session import broadcast_if_small, checkpointed

_SYMBOL = rf"[^\p{{L}}\p{{M}}\p{{N}}{K.WS_CLASS}]"


def alias_anchors(companies: DataFrame, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """One row per usable alias: the key to look it up by, and how to confirm a hit.

    A bounded occurrence of an alias implies that every run of letters in it is a whole run of the text, so the
    longest run serves as equi-join key.  An alias without letters is found by its first symbol."""
    edge_left, edge_right = r"(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])"
    spelled = companies.select(
        "company_id",
        F.explode(F.array_distinct(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))).alias("alias"),
    ).withColumn("needle", text.normalize(F.col("alias"))).where(F.length("needle") >= K.MIN_ALIAS_CHARS)
    runs = text.word_runs(F.col("needle"))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    symbol = F.regexp_extract(F.col("needle"), _SYMBOL, 0)
    escaped = F.regexp_replace("needle", r"([\\.\[\]{}()*+?^$|\-&#~])", r"\\$1")
    return (
        spelled.withColumn("anchor", F.coalesce(longest, symbol))
        .where(F.col("anchor") != "")
        .select(
            "company_id",
            "anchor",
            "needle",
            F.when(~((F.col("needle") == F.col("anchor")) & F.col("needle").rlike(f"^{K.WORD_RUN}$")),
                   F.concat(F.lit(edge_left), escaped, F.lit(edge_right))).alias("pattern"),
        )
        .distinct()
    )


def text_keys(folded: Column, shortest: int = 1, symbols: bool = True) -> Column:
    """Distinct letter runs of at least `shortest` characters, and symbols, of a lower-case text, in one pass: everything an alias can be anchored on."""
    runs = K.WORD_RUN if shortest < 2 else f"{K.WORD_RUN.removesuffix('+')}{{{shortest},}}"
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"{runs}|{_SYMBOL}" if symbols else runs), F.lit(0)))


def entity_match(items: DataFrame, companies: DataFrame, key: str = "item_id", body: Column | None = None,
                 scope: str | None = None) -> DataFrame:
    """(item, company) pairs in which a company name or alias occurs with Unicode word boundaries.

    `scope` restricts the match to companies already attached to the item through that column."""
    body = body if body is not None else F.concat("title", F.lit("\n"), "text")
    wanted = [c for c in (key, scope) if c]
    same_company = (F.col("company_id") == F.col(scope)) if scope and scope != "company_id" else F.lit(True)
    join_on = ["anchor", "company_id"] if scope == "company_id" else ["anchor"]
    # only keys are exploded; a text joins back once, to the candidates of its item that need the boundary check.  Keys hold no white space, so it is not collapsed for them
    anchors = checkpointed(alias_anchors(companies), "anchors")  # read three times
    kinds = anchors.agg(F.min(F.when(F.col("anchor").rlike(K.WORD_RUN), F.length("anchor"))).alias("shortest"), F.count_if(~F.col("anchor").rlike(K.WORD_RUN)).alias("symbols")).first()
    keyed = items.select(*wanted, F.explode(text_keys(F.lower(text.nfkc(body)), kinds["shortest"] or 1, kinds["symbols"] > 0)).alias("anchor"))
    candidates = keyed.join(broadcast_if_small(anchors), join_on).where(same_company)
    found = candidates.groupBy(key).agg(F.collect_set(F.struct("company_id", "needle", "pattern")).alias("found"))  # one entry per alias at most
    sure = F.transform(F.filter("found", lambda f: f["pattern"].isNull()), lambda f: f["company_id"])
    open_ = F.filter("found", lambda f: f["pattern"].isNotNull() & ~F.array_contains(F.col("sure"), f["company_id"]))
    split = checkpointed(found.withColumn("sure", sure).select(key, "sure", open_.alias("open")), "candidates")  # read twice; ids and patterns only
    texts = items.select(key, body.alias("_body"))
    confirmed = let(text.normalize(F.col("_body")), lambda norm: F.filter("open", lambda f: F.contains(norm, f["needle"]) & F.rlike(norm, f["pattern"])))  # normalised once for all of its patterns
    checked = split.where(F.size("open") > 0).select(key, "open").join(texts, key).select(key, F.explode(confirmed).alias("f")).select(key, F.col("f.company_id").alias("company_id"))
    return split.select(key, F.explode("sure").alias("company_id")).unionByName(checked).distinct()


def publisher_resolve(links: DataFrame, sources: DataFrame, link: str = "url",
                      alias_domains: Iterable[tuple[str, str]] = K.ALIAS_DOMAINS) -> DataFrame:
    """Monitored publisher of each address: the source whose host is the address's host or a parent domain of
    it; the first by source name.  Every parent domain of the host is an equi-join key."""
    own = url.publisher_host(with_ascii_host(F.col("url")))
    others = [F.when(F.col("domain") == a, F.lit(b)) for a, b in alias_domains]
    domains = sources.where("enabled").select("source_id", F.col("name").alias("source_name"), own.alias("domain")).withColumn(
        "domain", F.explode(F.array_compact(F.array("domain", *others))))
    first = domains.groupBy("domain").agg(F.min(F.struct("source_name", "source_id")).alias("source"))
    suffixes = lambda h: let(F.split(h, r"\."), lambda p: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    hosts = links.select(link).where(url.is_public_url(F.col(link))).distinct().withColumn("_host", F.regexp_replace(url.host(with_ascii_host(F.col(link))), r"^www\.", ""))
    # hosts are resolved once each; a single label such as `com` is no publisher and would be a hot key
    keyed = hosts.select("_host").distinct().withColumn("domain", F.explode(suffixes(F.col("_host"))))
    best = keyed.join(first, "domain").groupBy("_host").agg(F.min("source").alias("source"))
    return hosts.join(best, "_host").select(link, "source.source_id", "source.source_name")


def zone_of(region: Column) -> Column:
    out = None
    for zone, regions in K.ZONE_REGIONS:
        out = F.when(region.isin(*regions), zone) if out is None else out.when(region.isin(*regions), zone)
    return out.otherwise(F.lit(K.DEFAULT_ZONE))


def source_publisher(publisher: Column, source_url: Column) -> Column:
    """Publisher of a source: the listed one, else the host without `www.`."""
    return F.coalesce(publisher, F.regexp_replace(url.host(source_url), r"^www\.", ""))


def lookup(df: DataFrame, dimension: DataFrame, on: str, column: str, default: Column) -> DataFrame:
    """Left look-up of one column with a default for unknown keys."""
    return df.join(dimension.select(on, F.col(column).alias("_found")), on, "left").withColumn(
        column, F.coalesce("_found", default)).drop("_found")
