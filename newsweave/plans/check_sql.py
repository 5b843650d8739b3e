"""SQL fragments and views shared by the check queries (DuckDB dialect).  They restate the semantics on the
same parquet tables, without any of the Spark code."""

from __future__ import annotations

from newsweave import constants as K
from newsweave.plans.inputs import EVENT_RULES, TONE_RULES

WS = f"[{K.WS_CLASS}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'), ' ')"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def norm(x: str) -> str:
    return collapse(f"lower({x})")


def runs_of(x: str) -> str:
    return f"regexp_extract_all({x}, {q(K.WORD_RUN)})"


def tokens(x: str) -> str:
    return f"list_filter({runs_of(norm(x))}, lambda t: length(t) > 1 AND NOT list_contains({sql_list(K.STOP_WORDS)}, t))"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"({common} / greatest(1, len({a}) + len({b}) - {common})::DOUBLE)"


def sentence(x: str) -> str:
    parts = f"string_split(regexp_replace({x}, {q(f'([.!?।]){WS}+')}, '\\1' || chr(1), 'g'), chr(1))"
    trimmed = f"list_transform({parts}, lambda s: {trim_ws('s')})"
    return f"coalesce(list_filter({trimmed}, lambda s: length(s) > {K.MIN_SENTENCE_CHARS})[1], {trim_ws(x)})"


def rule_case(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {q(label)}" for label, p in rules)
    return f"CASE {whens} ELSE {q(default)} END"


def event(x: str) -> str:
    return rule_case(x, EVENT_RULES, K.DEFAULT_EVENT)


def tone(x: str) -> str:
    pos, neg, inv = (f"regexp_matches({x}, {q('(?i)' + p)})" for p in TONE_RULES)
    return f"CASE WHEN {inv} THEN 'unclear' WHEN {pos} AND {neg} THEN 'mixed' WHEN {pos} THEN 'positive' WHEN {neg} THEN 'negative' ELSE 'unclear' END"


def zone(x: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(q(r) for r in regions)}) THEN {q(z)}" for z, regions in K.ZONE_REGIONS)
    return f"CASE {whens} ELSE {q(K.DEFAULT_ZONE)} END"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]*)', 1))"


def canonical(x: str) -> str:
    """Canonical form of the plain absolute addresses of the test tables."""
    base = f"regexp_replace({x}, '#.*$', '')"
    path = f"split_part({base}, '?', 1)"
    path = f"CASE WHEN regexp_matches({path}, '^[a-z]+://[^/]+/*$') THEN regexp_replace({path}, '/*$', '/') ELSE regexp_replace({path}, '/+$', '') END"
    params = f"list_sort(list_filter(string_split(regexp_extract({base}, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)=')))"
    return f"({path} || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END)"


def strip_html(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g')"
    blocks = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in K.DROPPED_BLOCKS)
    out = f"regexp_replace({out}, {q('(?is)' + blocks)}, ' ', 'g')"
    return collapse(entities(f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"))


def entities(x: str) -> str:
    """Named entities (the test pages hold no numeric ones)."""
    for name, char in K.NAMED_ENTITIES:
        x = f"replace({x}, '&{name};', {q(char)})"
    return x


REGIONS = sql_list(K.REGIONS)
RAW_RUN = q(K.WORD_RUN)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), f"""
        WITH k AS (SELECT *, CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS uid FROM documents)
        SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, text,
          'https://src' || (uid % 20) || '.example.com/a/' || uid || '/?utm_source=rss&id=' || uid || '#top' AS url,
          source AS source_id, lang AS language,
          CASE WHEN doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 08:30:00' + INTERVAL 1 DAY * CAST(doc_id % 20 AS INT) END AS published_at,
          TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 MINUTE * CAST(doc_id AS INT) AS fetched_at,
          ({REGIONS})[CAST(doc_id % 39 AS INT) + 1] AS region
        FROM k"""),
    "watchlist": ((), f"""
        WITH t AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {RAW_RUN})) AS tok FROM documents) x WHERE length(tok) >= 6),
        r AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) AS rk FROM t GROUP BY tok)
        SELECT 'c' || (a.rk - 10) AS company_id, a.tok AS name, b.tok || ' the' AS alias, a.tok || '.example.com' AS domain
        FROM r a JOIN r b ON b.rk = a.rk + 20 WHERE a.rk BETWEEN 11 AND 30"""),
    "runs": ((), """
        SELECT event_id AS run_id, 'src' || (user_id % 20) AS source_id, ts AS started_at,
          CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'partial' ELSE 'success' END AS status,
          CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 7 AS INT)
            WHEN 0 THEN 'disallowed in robots.txt' WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'HTTP 429' WHEN 3 THEN 'HTTP 404'
            WHEN 4 THEN 'request timed out' WHEN 5 THEN 'hostname could not be resolved' ELSE 'broken stream' END END AS error
        FROM events"""),
    "sources": (("runs",), f"""
        WITH l AS (SELECT source_id, started_at AS last, status AS last_status, error AS last_error,
            CAST(substr(source_id, 4) AS INT) AS n
          FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1)
        SELECT source_id, 'Source ' || lpad(CAST(n AS VARCHAR), 2, '0') AS name, 'https://www.src' || n || '.example.com/rss' AS url,
          (['rss', 'web', 'discovery'])[n % 3 + 1] AS kind, ({REGIONS})[(n * 2) % 39 + 1] AS region, (['en', 'fr', 'de', 'es'])[n % 4 + 1] AS language,
          n % 7 <> 3 AS enabled,
          CASE WHEN n % 11 = 10 THEN 'unfetched' WHEN last_status = 'error' THEN 'error' ELSE 'healthy' END AS status,
          CASE WHEN n % 11 <> 10 THEN last END AS last_fetched_at, CASE WHEN n % 11 <> 10 THEN last_error END AS error,
          CASE WHEN n % 5 = 0 THEN 'Publisher ' || (n % 3) END AS publisher
        FROM l"""),
    # every run of letters is put in brackets, so a bounded alias is a bracketed substring
    "matches": (("items", "watchlist"), f"""
        WITH n AS (SELECT item_id, regexp_replace({norm("title || chr(10) || text")}, {q(f"({K.WORD_RUN})")}, '<<\\1>>', 'g') AS t FROM items),
        a AS (SELECT company_id, name AS alias FROM watchlist UNION ALL SELECT company_id, alias FROM watchlist),
        b AS (SELECT company_id, regexp_replace(alias, {q(f"({K.WORD_RUN})")}, '<<\\1>>', 'g') AS alias FROM a)
        SELECT DISTINCT n.item_id, b.company_id FROM n JOIN b ON contains(n.t, b.alias)"""),
    "articles": (("items", "matches"), f"""
        WITH m AS (SELECT m.company_id, i.*, {canonical("i.url")} AS curl FROM matches m JOIN items i USING (item_id)),
        f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY company_id, curl ORDER BY fetched_at, item_id) = 1)
        SELECT sha256(company_id || '|' || curl) AS article_id, company_id, item_id, source_id, source_id AS source_name, title, curl AS url, text,
          language, region, published_at, fetched_at, sha256({norm("text")}) AS content_hash,
          {event("title || chr(10) || text")} AS event_type, {tone("title || chr(10) || text")} AS sentiment,
          coalesce(nullif({sentence("text")}, ''), title) AS summary,
          CASE WHEN item_id % 4 = 0 THEN 'model' ELSE 'baseline' END AS mode,
          regexp_replace({host("curl")}, '^www[.]', '') AS publisher, coalesce(published_at, fetched_at) AS event_time
        FROM f"""),
    "near_pairs": (("articles",), f"""
        WITH s AS (SELECT article_id, company_id, content_hash, published_at, list_distinct({tokens("title")}) AS ts, list_distinct({tokens("text")}) AS xs FROM articles)
        SELECT a.company_id, a.article_id AS a_id, b.article_id AS b_id, {jaccard("a.ts", "b.ts")} AS title_similarity, {jaccard("a.xs", "b.xs")} AS text_similarity
        FROM s a JOIN s b ON a.company_id = b.company_id AND a.article_id <> b.article_id AND a.content_hash <> b.content_hash
          AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 259200
        WHERE {jaccard("a.ts", "b.ts")} >= 0.72 AND {jaccard("a.xs", "b.xs")} >= 0.45"""),
    "parents": (("articles", "near_pairs"), """
        WITH m AS (
          SELECT a.article_id AS a_id, b.article_id AS b_id FROM articles a JOIN articles b
            ON a.company_id = b.company_id AND a.content_hash = b.content_hash AND a.article_id <> b.article_id
          UNION SELECT a_id, b_id FROM near_pairs)
        SELECT a.article_id, (SELECT b.article_id FROM m JOIN articles b ON b.article_id = m.b_id
            WHERE m.a_id = a.article_id AND (b.fetched_at, b.article_id) < (a.fetched_at, a.article_id)
            ORDER BY b.event_time DESC, b.fetched_at, b.article_id LIMIT 1) AS parent_id
        FROM articles a"""),
    "roots": (("parents",), """
        WITH RECURSIVE w AS (
          SELECT article_id, article_id AS cluster_id FROM parents WHERE parent_id IS NULL
          UNION ALL SELECT p.article_id, w.cluster_id FROM parents p JOIN w ON p.parent_id = w.article_id)
        SELECT article_id, cluster_id FROM w"""),
    "clustered": (("articles", "roots"), "SELECT a.*, r.cluster_id FROM articles a JOIN roots r USING (article_id)"),
    "stories": (("clustered",), """
        SELECT *, count(*) OVER (PARTITION BY company_id, cluster_id) AS group_size FROM clustered
        QUALIFY row_number() OVER (PARTITION BY company_id, cluster_id ORDER BY event_time DESC, article_id) = 1"""),
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views and everything they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in VIEWS[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in order)
    return f"WITH {ctes}\n{body}" if order else body
