"""Jobs that add to stored tables: any order of slices, replays, and runs that stop in the middle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsweave.operators import clustering, story_index
from newsweave.session import scratch_path
from newsweave.sources import sync

DAY = dt.datetime(2024, 1, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def article_rows():
    """Chains of similar stories, copies, undated rows; arrival in an order of its own."""
    rows = []
    for i in range(48):
        story, version = i % 6, i // 6
        title = " ".join(WORDS[story : story + 8] + ([WORDS[15]] if version % 2 else []))
        text = " ".join(WORDS[(story + k) % 16] for k in range(12)) + (f" extra{version}" if i % 5 else "")
        published = DAY + dt.timedelta(days=version * 1.5, hours=story) if i % 11 else None
        rows.append((f"a{i * 29 % 48:02d}", f"c{story % 2}", title, text, text, published, DAY + dt.timedelta(days=20, minutes=i * 17 % 48)))
    return rows


@pytest.fixture(scope="module")
def articles(spark):
    rows = spark.createDataFrame(article_rows(), "article_id string, company_id string, title string, text string, content_hash string, published_at timestamp, fetched_at timestamp")
    return rows.coalesce(1).cache()


@pytest.mark.parametrize("late", [False, True])
def test_slices_equal_the_whole(spark, articles, late):
    want = {(r.article_id, r.cluster_id) for r in clustering.story_clusters(articles).collect()}
    assert len({c for _, c in want}) < len(want)
    minute = F.floor(F.minute("fetched_at") / 16)
    part = F.pmod(F.xxhash64("article_id"), F.lit(3)) if late else minute
    folder = scratch_path(spark, "stories")
    for n in range(3):
        story_index.cluster_increment(spark, folder, articles.where(part == n), n)
    story_index.cluster_increment(spark, folder, articles.where(part == 2), 2)  # delivered again
    assert {(r.article_id, r.cluster_id) for r in story_index.stored_stories(spark, folder).collect()} == want
    read = story_index.StoryStore(spark, folder).read("roots", 99)
    if not late:  # no stored story is touched, so no row is written twice
        assert read.count() == len(want)


def published(spark):
    entry = lambda i, company, source="s1", url=None: (source, company, f"Title {i}", url or f"https://news.example.com/{i}?utm_source=x", f"Acme and Bolt make news number {i}.", DAY, "en", "Global")
    pages = {("p1", 0): [entry(1, "acme"), entry(2, "acme"), entry(2, "acme", url="https://news.example.com/2/")], ("p1", 1): [entry(3, "bolt"), entry(4, "ghost"), entry(5, "acme", "s2")],
             ("p2", 0): [entry(1, "acme"), entry(1, "bolt"), entry(6, "acme", "s3"), entry(7, "acme", url="http://10.0.0.1/x")]}
    names = [f.name for f in spark.createDataFrame([], f"e {sync.ENTRY}").schema["e"].dataType]
    entries = spark.createDataFrame([(s, p, [dict(zip(names, e)) for e in some]) for (s, p), some in pages.items()], f"snapshot_id string, part int, entries array<{sync.ENTRY}>")
    ends = F.when(F.col("snapshot_id") == "p1", F.lit(DAY)).otherwise(F.lit(DAY + dt.timedelta(days=1)))
    parts = entries.select("snapshot_id", "part", F.to_json("entries").alias("payload"), ends.alias("started_at"), ends.alias("finished_at"), (F.col("snapshot_id") == "p2").alias("truncated")).cache()
    manifest = parts.select("snapshot_id", "part", sync.part_hash(F.col("payload")).alias("sha256"), "finished_at")
    results = spark.createDataFrame([("p1", "s1", "healthy", None, 4, 4), ("p1", "s2", "healthy", None, 1, 1), ("p2", "s1", "error", "HTTP 403", 0, 0)], "snapshot_id string, source_id string, status string, error string, scanned long, matched long")
    sources = spark.createDataFrame([("s1", "https://s1.example.com/rss", True, "unfetched", None, None), ("s2", "https://s2.example.com/rss", False, "unfetched", None, None), ("s3", "https://s3.example.com/rss", True, "healthy", None, DAY + dt.timedelta(days=9))],
                                    "source_id string, url string, enabled boolean, status string, error string, last_fetched_at timestamp")
    companies = spark.createDataFrame([("acme", "Acme", [], False), ("bolt", "Bolt", [], False)], "company_id string, name string, aliases array<string>, demo boolean")
    return manifest, parts, results, sources, companies, sources.where("source_id <> 's3'").select("source_id", "url"), companies


def tables_of(store, sources):
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(store.articles().select("article_id", "company_id", "url", "fetched_at")), rows(store.runs()), rows(store.source_state(sources)), str(store.cursor().asDict(True))


def test_sync_resumes_anywhere(spark, monkeypatch):
    tables, now = published(spark), F.lit(DAY + dt.timedelta(days=2))
    how = {"now": now, "parts_per_step": 1}
    whole = sync.snapshot_sync(spark, scratch_path(spark, "sync"), *tables, **how)
    want = tables_of(whole, tables[3])
    assert [r.url for r in whole.articles().orderBy("company_id", "url").collect()] == [f"https://news.example.com/{n}" for n in (1, 2, 1, 3)]
    runs = {(r.snapshot_id, r.source_id): r for r in whole.runs().collect()}
    assert (runs["p1", "s1"].inserted, runs["p1", "s1"].duplicates, runs["p1", "s1"].status) == (3, 1, "success") and ("p1", "s2") not in runs
    assert (runs["p2", "s1"].inserted, runs["p2", "s1"].duplicates, runs["p2", "s1"].status, runs["p2", "s1"].error) == (1, 1, "error", "HTTP 403")
    state = {r.source_id: r for r in whole.source_state(tables[3]).collect()}
    assert state["s1"].status == "error" and state["s2"].status == "unfetched" and state["s3"].last_fetched_at == DAY + dt.timedelta(days=9)

    folder, write, left = scratch_path(spark, "sync"), sync.SyncStore.write, [0]

    def dies(self, name, rows, step):
        write(self, name, rows, step)
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("lost")

    monkeypatch.setattr(sync.SyncStore, "write", dies)
    for after in (1, 2, 3):  # after the articles of the first step, after the run rows, after the state
        left[0] = after
        with pytest.raises(RuntimeError):
            sync.snapshot_sync(spark, folder, *tables, **how)
    monkeypatch.setattr(sync.SyncStore, "write", write)
    assert tables_of(sync.snapshot_sync(spark, folder, *tables, **how), tables[3]) == want
    assert list(sync.sync_steps(spark, folder, *tables, **how)) == []


def test_sync_rejects_what_the_manifest_does_not_list(spark):
    manifest, parts, *rest = published(spark)
    now = F.lit(DAY + dt.timedelta(days=2))
    folder = scratch_path(spark, "sync")
    bad = [(manifest, parts.withColumn("payload", F.concat("payload", F.lit(" ")))), (manifest, parts.where("part = 0")), (manifest.withColumn("finished_at", F.lit(DAY - dt.timedelta(days=1))), parts)]
    for m, p in bad:
        with pytest.raises(sync.SnapshotRejected):
            sync.snapshot_sync(spark, folder, m, p, *rest, now=now)
    with pytest.raises(sync.SnapshotRejected):
        sync.snapshot_sync(spark, folder, manifest, parts, *rest, now=F.lit(DAY - dt.timedelta(days=1)))
    assert sync.SyncStore(spark, folder).cursor() is None


def test_counter_maps(spark):
    rows = spark.createDataFrame([("a", True, 0), ("a", False, 0), ("b", True, 1), ("a", True, 1)], "source_id string, is_new boolean, step int")
    log = sync.count_outcomes(rows, ["step"])
    assert sorted(map(tuple, sync.total_counters(log.unionByName(log)).collect())) == [("a", 2, 1), ("b", 1, 0)]
    both = log.where("step = 0").select(F.col("counters").alias("x")).crossJoin(log.where("step = 1").select(F.col("counters").alias("y")))
    merged = both.select(sync.merge_counters(F.col("x"), F.col("y")).alias("m"), sync.merge_counters(F.lit(None).cast(sync.COUNTERS), F.col("y")).alias("n")).first()
    assert {k: tuple(v) for k, v in merged.m.items()} == {"a": (2, 1), "b": (1, 0)} and {k: tuple(v) for k, v in merged.n.items()} == {"a": (1, 0), "b": (1, 0)}
