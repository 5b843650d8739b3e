"""Decontamination, licences, languages, pages and the pipeline: brute force and odd rows."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsweave.llm import decontaminate, language_id, license_scan, queries, style_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contamination_brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_windows", [200_000, 50])
def test_contamination_equals_brute_force(spark, documents, sf, block_windows):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "Re."), (901, None), (902, "!!"), (None, "été of the")], "item_id long, text string"))
    found = decontaminate.find_contamination(documents, benchmark, block_windows=block_windows).withColumn("n_hit", decontaminate.hit_count())
    want = contamination_brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id if r.item_id is not None else "", r.text) for r in benchmark.collect()])
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()} == want


def test_decontamination_on_odd_rows(spark, odd):
    benchmark = spark.createDataFrame([(1, "beta gamma delta"), (2, "ÉLAN vital"), (2, "ÉLAN vital")], "item_id long, text string")
    docs = odd("items")
    kept = decontaminate.remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 6 and kept.filter("items = 'k'").count() > 0
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert cut[7].startswith("ALPHA  epsilon") and cut[2] is None and cut[9] == "été " * 30_000
    assert decontaminate.remove_documents(odd(rows=[]), benchmark).count() == 0
    assert decontaminate.remove_documents(docs, benchmark.limit(0)).count() == 10


def test_languages_on_held_out_texts(documents, odd):
    rows = documents.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    profiles = language_id.learn_profiles(rows.filter("not held_out"))
    found = language_id.identify(rows.filter("held_out"), profiles)
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()
    strange = {r.doc_id: r for r in language_id.identify(odd("lang_pred"), profiles).collect()}
    assert {i for i, r in strange.items() if r.lang_pred == "und"} == {2, 3, 4}
    assert strange[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in strange.values())
    assert language_id.learn_profiles(odd(rows=[])) == {}
    assert {r.lang_pred for r in language_id.identify(odd(), {}).collect()} == {"und"} and language_id.identify(odd(rows=[]), profiles).count() == 0


def test_language_vectors_of_pieces(monkeypatch):
    text = "les étés à la mer " * 50
    whole = language_id.text_vectors([text])
    monkeypatch.setattr(language_id, "TYPES", 7)
    assert abs(language_id.text_vectors([text]) - whole).max() < 1e-3
    brute = sum(_bound(text, i) for i in range(len(" ".join(["", *text.split(), ""])) - 2))
    assert abs(whole[0] - brute).max() < 1e-3


def _bound(text, i):
    import numpy as np

    clean = " ".join(["", *text.split(), ""])
    a, b, c = (language_id._letter_vector(ord(x), language_id.DIMENSIONS).astype(float) for x in clean[i : i + 3])
    return np.roll(a, 2) * np.roll(b, 1) * c


def test_licences_and_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0.\n"), ("a/b/c/x.py", "print(1)"),
        ("a/y.py", "some words here and there"), ("z.py", "nothing"), ("a/b/own.py", "# header\n# This work is licensed under the GNU General Public License, version 3.\ncode code code"),
        (None, None), ("q/", ""), ("a/bb/n.py", "about licences in general, the version of the work and the public"), ("a/b/c/x.py", "print(1)"),
    ]
    docs = spark.createDataFrame(files, "path string, text string").withColumn("is_license_file", F.coalesce(F.col("path").endswith("LICENSE"), F.lit(False))).withColumn("license", F.lit("old"))
    found = [(r.path, r.license, r.license_from, r.license_dir) for r in license_scan.scan_licenses(docs).collect()]
    assert sorted(found, key=str) == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/b/LICENSE", "Apache-2.0", "own", None), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"), ("a/y.py", "MIT", "inherited", "a"), ("z.py", None, None, None),
        ("a/b/own.py", "GPL-3.0", "own", None), (None, None, None, None), ("q/", None, None, None), ("a/bb/n.py", "MIT", "inherited", "a"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b")], key=str)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_licence_query_equals_a_search_up_the_tree(spark, sf):
    rows = queries.QUERIES["op5_license_scan"](spark, sf).collect()
    given = {}
    for r in sorted((r for r in rows if r.license_from == "own" and r.path.rpartition("/")[2].startswith("LICENSE")), key=lambda r: (-r.license_score, r.license)):
        given.setdefault(r.path.rpartition("/")[0], (r.license, r.license_score))
    steps = []
    for r in rows:
        if r.license_from != "own":
            up = start = r.path.rpartition("/")[0]
            while up and up not in given:
                up = up.rpartition("/")[0]
            assert (r.license, r.license_score, r.license_dir, r.license_from) == ((*given[up], up, "inherited") if up else (None,) * 4)
            steps += [start.count("/") - up.count("/")] if up else []
    assert len({r.path.count("/") for r in rows}) == 4 and len(given) > 0 and max(steps) > 0
    assert sum(len(r.path) for r in rows) and len({r.path for r in rows}) == len({r.doc_id for r in rows})


def test_whole_licence_files_get_their_own_names(spark):
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0"]
    texts = dict(license_scan.TEXTS)
    rows = [(n, f"Copyright (c) 2019 Ada Example and others\n\n{texts[n]}") for n in names] + [(f"prose {i}", f"the story of the day {i} and more of it") for i in range(200)]
    rows += [("GPL-3.0 title", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("GPL-2.0 title", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991")]
    found = {r.path: r.license for r in license_scan.match_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: n for p, n in found.items() if n} == {**{n: n for n in names}, "GPL-3.0 title": "GPL-3.0", "GPL-2.0 title": "GPL-2.0"}


def test_licence_scores_equal_brute_force(documents):
    import math
    from collections import Counter

    rows = documents.collect()
    vocabulary = {w for _, t in license_scan.NOTICES for w in words_of(t)}
    df = Counter(w for r in rows for w in set(words_of(r.text)) & vocabulary)
    idf = lambda w: math.log1p(len(rows) / (1 + (df[w] if w in vocabulary else 0)))

    def cosine(a, b):
        norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
        return sum(n * b[w] * idf(w) ** 2 for w, n in a.items()) / (norm(a) * norm(b)) if a and b else 0

    def best(text):
        lines = (text or "").split("\n")
        paragraphs, run = [], []
        for line in [*lines, ""]:
            if words_of(line):
                run.append(line)
            else:
                paragraphs, run = paragraphs + ["\n".join(run)], []
        return max(((round(cosine(Counter(words_of(p)), Counter(words_of(t))), 9), -k) for p in {*lines, *paragraphs, text or ""} for k, (_, t) in enumerate(license_scan.NOTICES)))

    for r in license_scan.match_licenses(documents).collect():
        value, k = best(r.text)
        assert (r.license, round(r.license_score or 0, 6)) == ((license_scan.NOTICES[-k][0], round(value, 6)) if value >= 0.6 else (None, 0))


PAGE = ('<!doctype html><html><head><title>t</title><script>var a = "</p>";</script></head><body class="sidebar"><header>Head</header><nav><ul><li>m</ul></nav><div class="cookie-notice">Cookies</div>'
        '<div id=wrap><article><h1>Title &amp; more</h1><p>One&nbsp;<b>bold</b>\n text<p>Two<br>lines<aside>side</aside><form>f</form><div class="ad-box ad">Buy</div><ul><li>x<li>y</ul>'
        '<section id="comments"><p>Nice!</p></section></article></div><!-- c --><footer>Foot</footer>')


def test_pages(spark):
    same = lambda i: f'<body><div class="top">Welcome</div><div class="text"><p>Story {i} goes on</p><p>More of {i}</p></div><div class="end">Imprint</div>'
    rows = [(1, "http://a.org/1", PAGE), (1, "http://a.org/1", PAGE), (2, None, None), (3, "http://b.org/", ""), *((10 + i, f"http://user@C.org/{i}", same(i)) for i in range(5)), *((20 + i, "http://copies.org/", same(9)) for i in range(6)), (30, "http://x.org/", "<p>" * 5000 + "deep" + "<div>" * 300)]
    found = [(r.page_id, r.text) for r in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit(1))).collect()]
    want = [(1, "Title & more\nOne bold text\nTwo lines\nx\ny")] * 2 + [(2, ""), (3, "")] + [(10 + i, f"Story {i} goes on\nMore of {i}") for i in range(5)]
    want += [(20 + i, "Welcome\nStory 9 goes on\nMore of 9\nImprint") for i in range(6)] + [(30, "deep")]
    assert sorted(found) == sorted(want)
    assert style_tree.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def main_texts(spark, bodies):
    rows = [(i, f"http://h.org/{i}", f"<body>{b}") for i, b in enumerate(bodies)]
    return [r.text for r in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_pages_with_a_main_element_pass_through_the_tree(spark):
    body = lambda i: (f'<h1 class="title">Headline {i}</h1><div class="strip">Follow us everywhere</div><article><p>Story {i}</p><p>More {i}</p><p>{"Shared by some" if i % 3 == 0 else i}</p>'  # noqa: E731
                      f'<div class="plea">Please support us</div></article>')
    want = lambda i: f"Headline {i}\nStory {i}\nMore {i}\n{'Shared by some' if i % 3 == 0 else i}"
    assert main_texts(spark, map(body, range(9))) == [want(i) for i in range(9)]
    assert main_texts(spark, [body(1)]) == ["Story 1\nMore 1\n1\nPlease support us"]  # one page shows no repetition: the main element alone counts


def test_class_words_inside_main_need_repetition(spark):
    body = lambda i: (f'<article><div class="entry-header"><h1>Title {i}</h1></div><header class="post-header">By {i}</header><p>Story {i}</p><section class="related-work">Earlier work {i}</section>'  # noqa: E731
                      f'<section class="share-box"><p>Share this</p></section><div class="ad">Buy {i}</div><section class="notice">{"Half notice" if i % 2 else f"Of {i}"}</section></article>')
    few = "Title 0\nBy 0\nStory 0\nEarlier work 0\nShare this\nOf 0"
    found = main_texts(spark, map(body, range(8)))
    assert [t.replace("\nHalf notice", "") for t in found] == [f"Title {i}\nBy {i}\nStory {i}\nEarlier work {i}" + ("" if i % 2 else f"\nOf {i}") for i in range(8)]
    assert main_texts(spark, [body(0)]) == [few]


def test_wrappers_named_like_boilerplate_keep_their_pages(spark):
    bodies = ['<div class="site has-sidebar"><article><p>One</p></article></div>', '<div id="no-sidebar"><main><p>Two</p></main></div>', '<form id="aspnetForm"><div class="page"><article><h1>Three</h1></article></div></form>',
              '<div class="banner-layout"><div><article><p>Four</p></article><div class="sidebar">beside</div></div></div>', '<form><p>A form that holds all the text of a page</p><div>And more of it</div></form><p>Five</p>',
              '<p>Six has a text of its own</p><form><p>Mail</p></form>', '<article class="post has-comments"><p>Seven</p></article>', '<header class="top"><nav>menu</nav>Top</header><p>Eight</p>']
    assert main_texts(spark, bodies) == ["One", "Two", "Three", "Four", "A form that holds all the text of a page\nAnd more of it\nFive", "Six has a text of its own", "Seven", "Eight"]


def test_reader_comments_go(spark):
    for names in ('class="comment-list"', 'class="user-comments"', 'id="reply-box"', 'class="post-replies"', 'id="disqus_thread"', 'class="respond"'):
        body = lambda i: f'<article><h1>Title {i}</h1><p>Story {i}</p><section {names}><div class="user-comment"><p>Reader {i} says {i * i}</p></div></section></article>'  # noqa: E731, B023
        assert main_texts(spark, map(body, range(12))) == [f"Title {i}\nStory {i}" for i in range(12)]
    assert main_texts(spark, ['<article><p>One <span class="share">two</span> three</p></article>']) == ["One two three"]


def test_tags_are_read_in_linear_time():
    import time

    blank = " " * 200_000
    for source in ("<p>x<div " + 'a="b" c=\'d\' e ' * 10_000, "<p>x<div " + "a='b\" " * 10_000, "<p>x" + '<a b="' * 10_000, "<p>x" + "<!" * 100_000, "<p>x<div a" + blank, f"<p>x<div a={blank}", f"<p>x<a {'=' * 100_000}", "<p>x" + "<a b=' " * 10_001):
        start = time.perf_counter()
        page = style_tree.Page(source)
        assert time.perf_counter() - start < 1 and page.blocks[0][0] == "x"
    assert [t for t, _ in style_tree.Page("<p title='never closed>One<p class=a/b id=\"c\">Two<p data-x = \"a>b\" lang=x>Three</p><i").blocks] == ["One", "Two", "Three"]
    assert style_tree._attributes(' a="1>2" B=\'x y\' c=d/e f  g = "&amp;" h') == ({"a": "1>2", "b": "x y", "c": "d/e", "f": "", "g": "&", "h": ""}, 40)


def style_tree_brute(pages):
    """Importance of every node of every host, by plain loops over the distinct pages."""
    import math

    hosts = {}
    for url, html in pages:
        page = style_tree.Page(html or "")
        hosts.setdefault(style_tree.host_of(url), {})[tuple(t for t, _ in page.blocks)] = page
    out = {}
    for host, distinct in hosts.items():
        for path in {e.path for p in distinct.values() for e in p.nodes}:
            having = [p for p in distinct.values() if any(e.path == path for e in p.nodes)]
            m = len(having)
            if m == 1:
                out[host, path] = (m, 1.0)
                continue
            styles = [s for p in having for s in {tuple(e.children) for e in p.nodes if e.path == path}]
            presentation = -sum(styles.count(s) / len(styles) * math.log(styles.count(s) / len(styles), m) for s in set(styles))
            texts = [t for p in having for t in {t for t, above in p.blocks if any(e.path == path for e in above)}]
            content = [math.log(texts.count(t), m) for t in set(texts)]
            mean = sum(content) / len(content) if content else 0.0
            out[host, path] = (m, (1 - style_tree.GAMMA) * presentation + style_tree.GAMMA * (1 - mean))
    return out


def test_importance_and_removals_equal_brute_force(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    layout = lambda i: (f'<body><div class="strip"><b>Shared</b></div><h1>Head {i}</h1><article><p>Story {i}</p><div class="box{i % 2}"><p>{"Half" if i % 2 else i}</p></div><section class="related"><p>See {i % 3}</p></section></article>'  # noqa: E731
                        f'<div class="end"><p>All rights</p>{"<p>odd</p>" if i % 2 else ""}</div>')
    own = spark.createDataFrame([(10_000 + i, f"http://own.org/{i}", layout(i % 9)) for i in range(12)], given.schema)
    for table in (given, own, own.repartition(5)):
        rows = table.collect()
        want = style_tree_brute([(r.url, r.html) for r in rows])
        got = {(r.host, r.path): (r.pages, r.importance) for r in style_tree.node_importance(table).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
        texts = {}
        for r in rows:
            nodes, blocks = style_tree.Page(r.html).judged()
            gone = set()
            for place, (path, kind) in enumerate(nodes):
                m, importance = want[style_tree.host_of(r.url), path]
                if importance + style_tree.PRIORS[kind] < style_tree.MIN_IMPORTANCE if m >= style_tree.MIN_PAGES else kind == style_tree.BESIDE:
                    gone.add(place)
            texts[r.page_id] = "\n".join(t for t, above in blocks if gone.isdisjoint(above))
        assert {r.page_id: r.text for r in style_tree.extract_main_text(table).collect()} == texts


def test_pipeline_stages_equal_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    letters = {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(stage["language_id"](spark, docs, sf)) == letters
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, (n, hit, _) in contamination_brute(rows.items(), benchmark).items() if not (hit and 20 * hit >= n)}
    assert ids(stage["decontaminate"](spark, docs, sf)) == clean
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= len(letters & clean) and len({r.doc_id for r in out}) == len(out)
    assert all(r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest() for r in out)
    for name, function in corpus_pipeline.STAGES[:-1]:
        strange = odd("score")
        assert function(spark, strange, sf).columns == strange.columns and function(spark, odd("score", []), sf).count() == 0


def test_personal_data_query_equals_brute_force(spark, sf):
    from test_pii import brute

    found = {r.doc_id: r for r in queries.QUERIES["op1_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = {k: brute(k, r.text or "") for k in ("email", "ip", "card", "phone")}
        text = ",".join(f"{k}:{a}:{b}" for k, some in spans.items() for a, b in some)
        got = found[r.doc_id]
        assert [got[f"n_{k}"] for k in spans] == [len(s) for s in spans.values()] and got.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(got.spans.split(",")) or not text


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(n) for n in range(1, 14)}
    assert zlib.crc32(b"7") % 4 in range(4)
