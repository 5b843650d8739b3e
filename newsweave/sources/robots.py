"""Exclusion-file policy: parse the rules of each host once, then test addresses by joining on the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions import url
from newsweave.functions.binding import let

_RULE = "struct<allow:boolean,value:string,pattern:string>"
_GROUP = f"struct<agents:array<string>,rules:array<{_RULE}>>"


def _lines(robots: Column) -> Column:
    """Directives of a file in order, as (name, value); comments and other lines are ignored."""
    clean = F.transform(F.split(robots, r"\r?\n"), lambda l: F.trim(F.substring_index(l, "#", 1)))
    directives = F.filter(clean, lambda l: l.rlike(r"^[A-Za-z0-9_-]+\s*:"))
    return F.transform(directives, lambda l: F.struct(
        F.lower(F.regexp_extract(l, r"^([A-Za-z0-9_-]+)\s*:", 1)).alias("name"),
        F.trim(F.regexp_extract(l, r"^[A-Za-z0-9_-]+\s*:\s*(.*)$", 1)).alias("value")))


def _pattern(value: Column) -> Column:
    """`*` is a wildcard and `$` an end anchor; everything else is literal."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(value, r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))


def parse_robots(files: DataFrame) -> DataFrame:
    """(host, line, agents, allow, value, pattern) rules with their group.  Input: host, robots.  The lines of one
    file form groups: an agent line after a rule starts a new group."""
    empty_group = F.array().cast(f"array<{_GROUP}>")
    new_rule = lambda l: F.struct((l["name"] == "allow").alias("allow"), l["value"].alias("value"), _pattern(l["value"]).alias("pattern"))
    no_rules = F.array().cast(f"array<{_RULE}>")

    def step(groups: Column, l: Column) -> Column:
        last = F.coalesce(F.try_element_at(groups, F.lit(-1)), F.struct(F.array().cast("array<string>").alias("agents"), no_rules.alias("rules")))
        head = F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0)))
        agent = F.array(F.lower(l["value"]))
        opened = F.struct(agent.alias("agents"), no_rules.alias("rules"))
        joined = F.struct(F.concat(last["agents"], agent).alias("agents"), last["rules"].alias("rules"))
        ruled = F.struct(last["agents"].alias("agents"), F.concat(last["rules"], F.array(new_rule(l))).alias("rules"))
        return (
            F.when((l["name"] == "user-agent") & (F.size(last["rules"]) > 0), F.concat(groups, F.array(opened)))
            .when(l["name"] == "user-agent", F.concat(head, F.array(joined)))
            .when(l["name"].isin("allow", "disallow") & (l["value"] != ""), F.concat(head, F.array(ruled)))
            .otherwise(groups).cast(f"array<{_GROUP}>")
        )

    return files.select("host", F.aggregate(_lines(F.col("robots")), empty_group, step).alias("groups"))


def applicable_rules(files: DataFrame, agent: str) -> DataFrame:
    """Rules of each host that apply to `agent`: groups naming it win over `*` groups, and a file that names it
    without any rule allows everything."""
    names_agent = lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a)
    specific = F.filter("groups", lambda g: F.exists(g["agents"], names_agent))
    general = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    chosen = F.when(F.size(specific) > 0, specific).otherwise(general)
    return parse_robots(files).select("host", F.flatten(F.transform(chosen, lambda g: g["rules"])).alias("rules"))


def robots_filter(links: DataFrame, files: DataFrame, agent: str, link: str = "url") -> DataFrame:
    """Add `allowed` to each address.  The rule with the longest path wins, allow wins ties, no rule allows.
    The rules of a host are one bounded row, so every address stays one row and a hot host is a skewed join key
    that adaptive execution splits."""
    rules = applicable_rules(files, agent)
    keyed = links.withColumn("host", url.host(F.col(link))).withColumn("_path", url.path_and_query(F.col(link)))
    hits = F.filter("rules", lambda r: F.rlike(F.col("_path"), r["pattern"]))
    winner = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["value"]).alias("n"), r["allow"].alias("allow"))))
    return keyed.join(rules, "host", "left").withColumn(
        "allowed", F.coalesce(let(winner, lambda w: w["allow"]), F.lit(True))).drop("_path", "rules")
