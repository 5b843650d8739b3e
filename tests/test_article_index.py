"""Jobs that need the keys and dates of articles only do not analyse texts."""

from newsweave.plans import coverage, ingestion, inputs

SF = "/root/testdata/sf0.001"


def test_jobs_on_keys_do_not_analyse_texts(spark, monkeypatch):
    monkeypatch.setattr(inputs, "_STORED", {})
    for query in (coverage.latest_per_company, coverage.coverage_by_company, coverage.enrich_backlog, ingestion.excerpt_import):
        assert query(spark, SF).count() > 0
    assert {name for _, _, name in inputs._STORED} == {"watchlist", "matches", "chosen", "article_index"}
    common = ["article_id", "company_id", "item_id", "source_id", "url", "region", "published_at", "fetched_at"]
    index, whole = inputs.article_index(spark, SF).select(*common), inputs.articles(spark, SF).select(*common)
    assert index.count() == whole.count() and index.exceptAll(whole).isEmpty()
