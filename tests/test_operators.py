"""Operators on small inputs: golden evaluation, brute-force comparisons, flows and invariants."""

import datetime as dt
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import golden_data
from newsweave import constants as K
from newsweave.functions import text
from newsweave.operators import admission, articles, clustering, filters, matching, merge, quality, ranking, reports, retrieval
from newsweave.sources import snapshots
from newsweave.streaming import jobs

T0 = dt.datetime(2026, 9, 1, 9)


# --- matching ---------------------------------------------------------------------------------------------

COMPANIES = [("tcs", "Tata Consultancy Services", ["TCS", "டிசிஎஸ்"]), ("mm", "Mahindra & Mahindra", ["M&M"]), ("cpp", "C++", ["!!", "x"]), ("none", "Zoho", None)]
TEXTS = {
    1: ("TCS announces results", {"tcs"}), 2: ("ATCSoftware announces results", set()), 3: ("டிசிஎஸ் நிறுவனம் புதிய அறிவிப்பு", {"tcs"}),
    4: ("the (Mahindra  &\nMahindra) plant", {"mm"}), 5: ("mahindra and mahindra", set()), 6: ("written in C++, mostly", {"cpp"}), 7: ("written in C+", set()),
    8: ("stop !! now", {"cpp"}), 9: ("m&m and tcs.", {"mm", "tcs"}), 10: ("ＴＣＳ wide form", {"tcs"}), 11: ("tata consultancy", set()), 12: ("ac++ no", set()),
}


@pytest.mark.parametrize("small", [True, False])
def test_entity_match(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "broadcast_if_small", lambda df, *a: F.broadcast(df) if small else df)
    companies = spark.createDataFrame(COMPANIES, "company_id string, name string, aliases array<string>")
    items = spark.createDataFrame([(i, "", t) for i, (t, _) in TEXTS.items()], "item_id long, title string, text string")
    got = {(r.item_id, r.company_id) for r in matching.entity_match(items, companies).collect()}
    assert got == {(i, c) for i, (_, cs) in TEXTS.items() for c in cs}


@pytest.mark.parametrize("small", [True, False])
def test_entity_match_scoped(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "broadcast_if_small", lambda df, *a: F.broadcast(df) if small else df)
    companies = spark.createDataFrame(COMPANIES, "company_id string, name string, aliases array<string>")
    rows = spark.createDataFrame([(1, "tcs", "m&m and tcs"), (2, "cpp", "m&m and tcs"), (3, "mm", "m&m")], "row_id long, company_id string, text string")
    got = {(r.row_id, r.company_id) for r in matching.entity_match(rows, companies, key="row_id", body=F.col("text"), scope="company_id").collect()}
    assert got == {(1, "tcs"), (3, "mm")}


def test_publisher_alias_domain(spark):
    sources = spark.createDataFrame([("b", "Broadcaster", "https://feeds.bbci.co.uk/x", True), ("o", "Off", "https://off.example.com/", False)], "source_id string, name string, url string, enabled boolean")
    links = spark.createDataFrame([("https://www.bbc.com/news/1",), ("https://news.bbc.co.uk/1",), ("https://notbbc.com/",), ("https://off.example.com/a",), ("https://bbci.co.uk/",)], "url string")
    assert {r.url for r in matching.publisher_resolve(links, sources).collect()} == {"https://www.bbc.com/news/1", "https://news.bbc.co.uk/1", "https://bbci.co.uk/"}


# --- ranking helpers ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [200_000, 20])
def test_full_rank_equals_window(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "GROUP_ROWS", limit)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < .7 else "cold", i, 1.5 if rng.random() < .3 else round(rng.random() * 5, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, score double")
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    got = retrieval.ranked(df, 0).join(plain, ["query_id", "doc_id"])
    assert got.where("rank != r").count() == 0 and got.count() == 600


@pytest.mark.parametrize("limit", [200_000, 20, 2])
def test_running_min_equals_window(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "GROUP_ROWS", limit)
    rng = random.Random(2)
    rows = [("hot" if rng.random() < .7 else f"k{i % 9}", i, rng.randrange(50), rng.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, at long, v long")
    order = Window.partitionBy("k").orderBy("at", "id")
    plain = df.select("id", F.min("v").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("want"))
    got = ranking.running_min(df, ["k"], "v", [F.floor(F.col("at") / 10), F.col("at"), F.floor(F.col("id") / 50)], [F.col("at"), F.col("id")], "got")
    assert got.join(plain, "id").where("not (got <=> want)").count() == 0 and got.count() == 400


def test_within_quota_keeps_all_rows(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(40)] + [(9, 99)], "g long, n long")
    got = ranking.within_quota(df, ["g"], [F.col("n")], 5)
    assert got.count() == 41 and {(r.g, r["count"]) for r in got.where("admitted").groupBy("g").count().collect()} == {(0, 5), (1, 5), (2, 5), (9, 1)}
    assert got.where("admitted").agg(F.max("n")).first()[0] == 99 and got.where("admitted and g = 0").agg(F.max("n")).first()[0] == 12


# --- clustering ---------------------------------------------------------------------------------------------

def _article(i, company, title, body, day, arrival):
    published = None if day is None else T0 + dt.timedelta(days=day)
    return (f"a{i:03}", company, title, body, published, T0 + dt.timedelta(days=40, minutes=arrival))


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "article_id string, company_id string, title string, text string, published_at timestamp, fetched_at timestamp")
    return df.withColumn("content_hash", text.fingerprint(F.col("text")))


def _words(t):
    return {w for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in K.STOP_WORDS}


def _similar(a, b):
    x, y = _words(a), _words(b)
    return len(x & y) / max(1, len(x | y))


def _brute_clusters(rows):
    """Sequential definition: newest matching article that arrived earlier gives the cluster."""
    done = []
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        fits = []
        for s, cluster in done:
            if s[1] != r[1]:
                continue
            same = " ".join(s[3].lower().split()) == " ".join(r[3].lower().split())
            near = s[4] and r[4] and abs(s[4] - r[4]) <= dt.timedelta(days=3) and _similar(s[2], r[2]) >= .72 and _similar(s[3], r[3]) >= .45
            if same or near:
                fits.append((-(s[4] or s[5]).timestamp(), s[5], s[0], cluster))
        done.append((r, min(fits)[3] if fits else r[0]))
    return {r[0]: c for r, c in done}


def _random_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    stories = [([f"t{rng.randrange(40)}" for _ in range(7)], [rng.choice(vocabulary) for _ in range(30)]) for _ in range(6)]
    rows = []
    for i in range(n):
        title, body = (list(x) for x in rng.choice(stories))
        for words, chance in ((title, .08), (body, .15)):
            for j in range(len(words)):
                if rng.random() < chance * rng.random() * 2:
                    words[j] = f"z{rng.randrange(50)}"
        day = None if rng.random() < .1 else rng.randrange(12)
        rows.append(_article(i, rng.choice("ab"), " ".join(title), " ".join(body), day, rng.randrange(120)))
    for i in range(n, n + n // 4):  # exact copies
        c = rng.choice(rows)
        rows.append((f"a{i:03}", *c[1:4], rng.choice([c[4], T0, None]), c[5] + dt.timedelta(minutes=rng.randrange(200))))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 5_000), (2, 2)])
def test_clusters_equal_sequential_definition(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(clustering, "HOT_KEY_ROWS", hot)
    monkeypatch.setattr(ranking, "GROUP_ROWS", hot)
    rows = _random_rows(seed, 90)
    got = {r.article_id: r.cluster_id for r in clustering.story_clusters(_frame(spark, rows)).collect()}
    want = _brute_clusters(rows)
    assert got == want and 5 < len(set(want.values())) < len(rows)


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clustering, "HOT_KEY_ROWS", 3)
    rows = [r for r in _random_rows(5, 80)[:80]]
    got = {(r.left_variant_id, r.right_variant_id) for r in clustering.near_duplicate_pairs(_frame(spark, rows)).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2)
            if a[1] == b[1] and a[3] != b[3] and a[4] and b[4] and abs(a[4] - b[4]) <= dt.timedelta(days=3)
            and _similar(a[2], b[2]) >= .72 and _similar(a[3], b[3]) >= .45}
    assert got == want and want


def test_cluster_rules(spark):
    t, x = "Company opens a battery centre in Chennai", "A battery research centre was announced by the company in the city today"
    rows = [_article(1, "a", t, x, 0, 0), _article(2, "b", t, x, 0, 1), _article(3, "a", t, x + " again", 9, 2), _article(4, "a", t, x + " more", 2, 3),
            _article(5, "a", "other", x.upper().replace(" ", "  "), None, 4), _article(6, "a", t, x + " undated", None, 5)]
    got = {r.article_id: r.cluster_id for r in clustering.story_clusters(_frame(spark, rows)).collect()}
    assert got == {"a001": "a001", "a002": "a002", "a003": "a003", "a004": "a001", "a005": "a001", "a006": "a006"}


def test_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(100)], "article_id string, parent_id string")
    assert {r.cluster_id for r in clustering.resolve_roots(links).collect()} == {"n000"}


# --- retrieval ------------------------------------------------------------------------------------------------

def test_golden_evaluation(spark):
    rows = []
    for doc_id, cluster, title, body in golden_data.STORIES:
        rows.append((doc_id, cluster, "original", f"{title} {body}"))
        rows.append((doc_id, cluster, "translated", f"{title} {body} {golden_data.TRANSLATIONS.get(doc_id, '')}"))
    docs = spark.createDataFrame(rows, "doc_id string, cluster_id string, scope string, text string")
    asked = spark.createDataFrame([(f"{m}:{i}", m, q) for m in golden_data.EXPECTED for i, q, _ in golden_data.QUESTIONS], "query_id string, scope string, text string")
    relevant = spark.createDataFrame([(f"{m}:{i}", c) for m in golden_data.EXPECTED for i, _, cs in golden_data.QUESTIONS for c in cs], "query_id string, cluster_id string")
    scores = retrieval.bm25_scores(retrieval.with_terms(docs, F.col("text")), asked)
    clusters = docs.select("doc_id", "cluster_id").distinct()
    rankings = retrieval.one_per_cluster(scores, clusters, k=100).withColumn("mode", F.substring_index("query_id", ":", 1))
    report = retrieval.retrieval_eval(rankings, relevant, asked.select("query_id", F.col("scope").alias("mode")))
    got = {r["mode"]: (round(r.recall_at_k, 3), round(r.mrr, 3), r.abstention) for r in report.collect()}
    assert got == golden_data.EXPECTED


def test_bm25_abstains_and_fusion_prefers_agreement(spark):
    docs = retrieval.with_terms(spark.createDataFrame([("a", "all", "battery centre"), ("b", "all", "water use")], "doc_id string, scope string, text string"), F.col("text"))
    asked = spark.createDataFrame([(1, "all", "football scores"), (2, "all", "the and of"), (3, "all", "water water battery")], "query_id long, scope string, text string")
    assert {r.query_id for r in retrieval.bm25_topk(docs, asked).collect()} == {3}
    rank = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id string, rank int")
    fused = retrieval.rrf_fuse([rank([(1, "a", 1), (1, "b", 2)]), rank([(1, "b", 1), (1, "c", 2)])])
    assert fused.orderBy(F.desc("score")).first().doc_id == "b"


def test_vector_scan_blocks_models_and_dimensions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rng = random.Random(3)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    docs = [(i, vec(3 if i % 5 == 0 else 4), "m1" if i % 3 else "m2") for i in range(60)] + [(60, [], "m1"), (61, [0.0] * 4, "m1")]
    asked = [(i, vec(3 if i == 2 else 4), "m1" if i % 2 else "m2") for i in range(7)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>, model string")
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>, model string")

    def cosine(a, b):
        root = (sum(x * x for x in a) * sum(y * y for y in b)) ** .5
        return sum(x * y for x, y in zip(a, b)) / (root or 1)

    want = {(qi, di, round(cosine(qv, dv), 9)) for qi, qv, qm in asked for di, dv, dm in docs if dm == qm and len(dv) == len(qv) and dv and cosine(qv, dv) >= .28}
    got = {(r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.vector_scores(d, q).collect()}
    assert got == want and want
    top = {(r.query_id, r.doc_id) for r in retrieval.vector_topk(d, q, k=3).collect()}
    for qi in range(7):
        mine = sorted(((-s, di) for q2, di, s in want if q2 == qi))[:3]
        assert {x for x in top if x[0] == qi} == {(qi, di) for _, di in mine}


def test_citation_check(spark):
    rows = [("ok [1] and [2]", ["1", "2"], False), ("none", ["1"], False), ("x [1]", [], False), ("x [9]", ["9"], False), ("x [1] [2]", ["1"], False), ("none", [], True)]
    df = spark.createDataFrame(rows, "answer string, citation_ids array<string>, insufficient_evidence boolean").withColumn("supplied_ids", F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    got = [r.status for r in retrieval.citation_check(df).collect()]
    assert got == ["ok", "missing", "missing", "invalid", "incomplete", "ok"]


# --- merging, admission, quality ----------------------------------------------------------------------------

def test_insert_ignore_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    incoming = spark.createDataFrame([("a", 2), ("b", 5), ("b", 3)], "k string, v int")
    new = merge.insert_ignore(target, incoming, ["k"], [F.col("v")])
    assert [tuple(r) for r in new.collect()] == [("b", 3)]
    assert merge.insert_ignore(target.unionByName(new), incoming, ["k"], [F.col("v")]).isEmpty()


def test_update_newer(spark):
    t = dt.datetime
    target = spark.createDataFrame([("a", "old", t(2026, 1, 5)), ("b", "old", None), ("c", "old", t(2026, 1, 1))], "id string, status string, at timestamp")
    results = spark.createDataFrame([("a", "new", t(2026, 1, 4)), ("b", "new", t(2026, 1, 1)), ("b", "newest", t(2026, 1, 2))], target.schema)
    assert {(r.id, r.status) for r in merge.update_newer(target, results, "id", "at", ["status"]).collect()} == {("a", "old"), ("b", "newest"), ("c", "old")}


def test_upsert_preserves_other_columns(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "id int, name string, created string")
    updates = spark.createDataFrame([(2, None, "x"), (3, "c", "new")], target.schema)
    assert {tuple(r) for r in merge.upsert(target, updates, ["id"], ["name"]).collect()} == {(1, "a", "keep"), (2, None, "keep"), (3, "c", "new")}


def test_seed_upgrade_keeps_edits(spark):
    existing = spark.createDataFrame([("i", "Edited", "u1")], "id string, name string, url string")
    seed = spark.createDataFrame([("i", "Seed", "u1"), ("j", "J", "u2"), ("k", "K", "u1")], existing.schema)
    assert {tuple(r) for r in merge.seed_upgrade(existing, seed, ["id", "url"], "1", "2").collect()} == {("i", "Edited", "u1"), ("j", "J", "u2")}
    assert merge.seed_upgrade(existing, seed, ["id", "url"], "2", "2").count() == 1


def test_candidate_cap_refuses_the_batch(spark):
    queued = spark.createDataFrame([("j", f"u{i}") for i in range(9)], "job_id string, url string")
    incoming = spark.createDataFrame([("j", "u1", "s"), ("j", "v", "s2"), ("j", "v", "s1")], "job_id string, url string, source_id string")
    assert [tuple(r) for r in merge.candidate_append(queued, incoming, cap=10).collect()] == [("j", "v", "s1", True)]
    assert [tuple(r) for r in merge.candidate_append(queued, incoming, cap=9).collect()] == [("j", "v", "s1", False)]


def test_document_pages(spark):
    long = "Zoho opened an office. " * 6
    companies = spark.createDataFrame([("z", "Zoho", [])], "company_id string, name string, aliases array<string>")
    pages = spark.createDataFrame([("d1", "z", 1, long, False, None), ("d1", "z", 2, "no name here " * 10, False, None), ("d2", "z", 1, "scan", True, long), ("d3", "z", 1, "scan", False, long)],
                                  "doc_id string, company_id string, page_no int, text string, reviewed boolean, ocr_text string")
    admitted = admission.page_admission(pages, companies, ocr=True)
    assert {(r.doc_id, r.page_no): (r.outcome, r.content_scope) for r in admitted.collect()} == {
        ("d1", 1): ("imported", "pdf-text"), ("d1", 2): ("entity_not_named", None), ("d2", 1): ("imported", "pdf-ocr"), ("d3", 1): ("awaiting_review", None)}
    assert {(r.doc_id, r.articles, r.status) for r in admission.document_status(admitted).collect()} == {("d1", 1, "completed"), ("d2", 1, "completed"), ("d3", 0, "review")}


def test_quality(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None), (3, "")], "id int, name string")
    valid, rejected = quality.split_valid(df, {"name_present": F.length("name") > 0, "small": F.col("id") < 3})
    assert [r.id for r in valid.collect()] == [1]
    assert {(r.id, tuple(r.violations)) for r in rejected.collect()} == {(2, ("name_present",)), (3, ("name_present", "small"))}


def test_error_taxonomy_order(spark):
    messages = ["blocked by robots 403", "HTTP 401", "HTTP 429", "no RSS", "The request timed out", "public addresses only", "??", ""]
    rows = reports.error_taxonomy(spark.createDataFrame([(m,) for m in messages], "error string")).collect()
    assert {r.category: r.n for r in rows} == {c: 1 for c in [*[x for x, _ in K.FAILURE_RULES], K.DEFAULT_FAILURE]}


def test_page_clamp(spark):
    df = spark.range(25)
    assert [r.id for r in filters.page_of(df, [F.col("id")], 9).collect()] == [24]
    assert filters.page_of(df.limit(0), [F.col("id")], 3).count() == 0


def test_digest_files(spark, tmp_path):
    rows = _frame(spark, [_article(1, "a", "T", "x " * 50, 0, 0)]).withColumn("analysis", text.baseline_analysis(F.col("title"), F.col("text"))).withColumns(
        {"cluster_id": F.col("article_id"), "source_id": F.lit("s"), "region": F.lit("India"), "language": F.lit("en")})
    sections = reports.digest_sections(rows, spark.createDataFrame([("a", "Name")], "company_id string, name string"))
    reports.write_digests(sections, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).where("value = '## T'").count() == 1


# --- articles and enrichment ----------------------------------------------------------------------------------

def _items(spark):
    return spark.createDataFrame([
        (1, "Zoho grows", "Zoho revenue grows again according to the latest statement.", "https://n.example.com/a?utm_source=x", "s", "en", "India", T0, T0),
        (2, "Zoho repeat", "Zoho revenue grows, same address.", "https://n.example.com/a", "s", "en", "India", T0, T0 + dt.timedelta(minutes=1)),
        (3, "Nothing", "No company here.", "https://n.example.com/b", "s", "en", "India", T0, T0)],
        "item_id long, title string, text string, url string, source_id string, language string, region string, published_at timestamp, fetched_at timestamp")


def test_build_articles_twice_gives_same_ids(spark):
    companies = spark.createDataFrame([("z", "Zoho", [], False), ("d", "Nothing", [], True)], "company_id string, name string, aliases array<string>, demo boolean")
    rows = articles.build_articles(_items(spark), companies).collect()
    assert [(r.company_id, r.item_id, r.url, r.analysis.event_type, r.analysis.sentiment) for r in rows] == [("z", 1, "https://n.example.com/a", "Financial results", "positive")]
    assert articles.build_articles(_items(spark), companies).first().article_id == rows[0].article_id


def test_enrich_validates_and_falls_back(spark):
    companies = spark.createDataFrame([("z", "Zoho", [], False)], "company_id string, name string, aliases array<string>, demo boolean")
    base = articles.build_articles(_items(spark), companies)

    def model(quote):
        body = '{"event_type":"E","sentiment":"mixed","summary":"s","facts":[{"claim":"c","quote":"%s"}],"impacts":[],"uncertainty":"u"}' % quote
        return lambda batch: [body] * len(batch)

    def vector(value):
        return lambda batch: [value] * len(batch)

    def failing(batch):
        raise ValueError("no service")

    for quote in ("zoho REVENUE  grows", "Ｚｏｈｏ ｒｅｖｅｎｕｅ grows", " zoho revenue grows "):
        good = articles.enrich(base, model(quote), vector([1.0, 2.0]), "m").first()
        assert (good.analysis.mode, good.analysis.model, good.embedding_model, good.warning) == ("model", "m", "m", None)
    bad = articles.enrich(base, model("this was never written"), vector([float("nan")]), "m").first()
    assert (bad.analysis.mode, bad.embedding, bad.embedding_model) == ("baseline", None, None) and "validation" in bad.warning
    broken = articles.enrich(base, failing, vector([1.0]), "m").first()
    assert (broken.analysis.mode, broken.warning, broken.embedding) == ("baseline", "no service", [1.0])


def test_enrichment_isolates_failing_rows():
    batch = pd.DataFrame({"n": range(10)})

    def picky(part):
        if (part["n"] % 4 == 3).any():
            raise ValueError("bad row")
        return [n * 10 for n in part["n"]]

    results, errors = articles._per_row(picky, batch)
    assert results == [None if n % 4 == 3 else n * 10 for n in range(10)]
    assert errors == ["bad row" if n % 4 == 3 else None for n in range(10)]


def test_null_keys_keep_their_rows(spark):
    rows = [("a", 1, 5), ("a", 2, 3), (None, 3, 4), (None, 4, 1), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    quota = ranking.within_quota(df, ["k"], [F.col("id")], 1).orderBy("id").collect()
    assert [(r.id, r.admitted) for r in quota] == [(1, True), (2, False), (3, True), (4, False), (5, True)]
    ranks = ranking.full_rank(df, ["k"], [F.col("v"), F.col("id")], [F.col("v"), F.col("id")]).orderBy("id").collect()
    assert [(r.id, r.rank) for r in ranks] == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 1)]
    for crowded in (0, 200_000):
        before = ranking.GROUP_ROWS
        ranking.GROUP_ROWS = crowded
        try:
            low = ranking.running_min(df, ["k"], "v", [F.col("id")], [F.col("id")], "low").orderBy("id").collect()
        finally:
            ranking.GROUP_ROWS = before
        assert [(r.id, r.low) for r in low] == [(1, None), (2, 5), (3, None), (4, 4), (5, None)]
    manifest = spark.createDataFrame([(None, "1"), (None, "2"), ("s", "1")], "stream_id string, snapshot_id string")
    kept = snapshots.manifest_retain(manifest, manifest.limit(0), keep=1).collect()
    assert sorted((r.stream_id or "", r.snapshot_id, r.kept) for r in kept) == [("", "1", False), ("", "2", True), ("s", "1", True)]


# --- streaming ------------------------------------------------------------------------------------------------

def test_ingest_resumes_and_ignores_known_keys(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = lambda ids: spark.createDataFrame([(f"k{i}", i) for i in ids], "k string, v int").coalesce(1)
    rows(range(40)).write.mode("append").parquet(source)
    run = lambda: jobs.ingest(jobs.read_stream(spark, source, "k string, v int", max_files=1), target, checkpoint, ["k"], [F.col("v")]).count()
    assert run() == 40
    rows(range(30, 45)).write.mode("append").parquet(source)
    assert run() == 45
    assert run() == 45


@pytest.mark.parametrize("files", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_stateful_jobs_do_not_depend_on_arrival(spark, tmp_path, files):
    source = str(tmp_path / "in")
    schema = "user string, ts timestamp, n long"
    hours = [0, 1, 5, 6, 7, 11.5, 12, 30, 120]
    rows = [("u", T0 + dt.timedelta(hours=h), j) for j, h in enumerate(hours)] + [(None, T0, 20), ("v", None, 21)]
    for i in files:
        spark.createDataFrame([r for r in rows if r[2] % 3 == i], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.close_stream(spark.createDataFrame(rows, schema), source, "ts", "90 DAYS")
    stream = lambda: jobs.read_stream(spark, source, schema, max_files=1)
    gate = jobs.drain(jobs.cooldown(stream(), "user", "ts", "n", 6 * 3600, "30 days"), str(tmp_path / "g"), str(tmp_path / "gc"))
    assert [r.n for r in gate.where("accepted").orderBy("n").collect()] == [0, 3, 6, 7, 8, 20]
    assert [(r.n, r.accepted) for r in gate.where("late").collect()] == [(21, None)] and gate.count() == 11
    seen = jobs.drain(jobs.repeats(stream(), "user", "ts", "n", 3, "30 days"), str(tmp_path / "r"), str(tmp_path / "rc"))
    assert [r.n for r in seen.where("not repeated").orderBy("n").collect()] == [0, 8, 20]


def test_rows_behind_the_watermark_go_aside(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "user string, ts timestamp, n long"
    for day, n in ((0, 0), (10, 1), (20, 2), (2, 3), (21, 4)):
        spark.createDataFrame([("u", T0 + dt.timedelta(days=day), n)], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.close_stream(spark.createDataFrame([("u", T0 + dt.timedelta(days=30), 9)], schema), source, "ts", "30 DAYS")
    seen = jobs.drain(jobs.repeats(jobs.read_stream(spark, source, schema, max_files=1), "user", "ts", "n", 3, "1 day"), str(tmp_path / "r"), str(tmp_path / "rc"))
    assert [(r.n, r.repeated, r.late) for r in seen.orderBy("n").collect()] == [(0, False, False), (1, False, False), (2, False, False), (3, None, True), (4, True, False)]


def test_ingest_keeps_the_first_in_order(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in ([("a", 5), ("b", 1), (None, 4)], [("a", 3), ("c", 2), (None, 6)], [("a", 9), ("b", 0)]):
        spark.createDataFrame(part, "k string, v int").coalesce(1).write.mode("append").parquet(source)
    rows = jobs.ingest(jobs.read_stream(spark, source, "k string, v int", max_files=1), target, checkpoint, ["k"], [F.col("v")])
    assert {r.k: r.v for r in rows.collect()} == {"a": 3, "b": 0, "c": 2, None: 4}


def test_source_state_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "source_id string, status string, at timestamp"
    spark.createDataFrame([("a", "healthy", T0)], schema).write.parquet(f"{target}/version=0")
    spark.createDataFrame([("a", "late", T0 - dt.timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("a", "error", T0 + dt.timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.update_source_state(jobs.read_stream(spark, source, schema, max_files=1), target, str(tmp_path / "c"), "source_id", "at", ["status"])
    assert [r.status for r in spark.read.parquet(f"{target}/version=2").collect()] == ["error"]
