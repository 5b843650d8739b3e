"""Costly steps over whole texts run once: per text, and per item instead of per company."""

from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text
from newsweave.operators import articles, matching


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, folder):
    rows = [(i, f"t{i} Acme Corp", f"Acme  Corp and\tBeta {i}", f"https://a.example.com/{i}", "s", "en") for i in range(6)]
    items = spark.createDataFrame(rows, "item_id long, title string, text string, url string, source_id string, language string").withColumns(
        {"region": F.lit("India"), "published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    items.write.parquet(f"{folder}/items")
    companies = spark.createDataFrame([("c1", "Acme Corp", []), ("c2", "Beta", ["Acme Corp"]), ("c3", "Gamma", [])], "company_id string, name string, aliases array<string>")
    return spark.read.parquet(f"{folder}/items"), companies.withColumn("demo", F.lit(False))


def test_items_are_searched_for_aliases_once(spark, tmp_path):
    items, companies = _tables(spark, str(tmp_path))
    found = matching.entity_match(items, companies)
    assert "regexp_extract_all" not in _plan(found)  # the keys are not extracted again for each branch
    assert sorted(map(tuple, found.collect())) == [(i, c) for i in range(6) for c in ("c1", "c2")]


def test_an_item_is_analysed_once_for_all_its_companies(spark, tmp_path):
    items, companies = _tables(spark, str(tmp_path))
    built = articles.build_articles(items, companies)
    plan = _plan(built)
    assert plan.index("Generate explode(_companies") < plan.index("(?iu)")  # rules below the explosion
    assert built.count() == 12 and built.select("article_id").distinct().count() == 12


def test_white_space_and_scripts(spark):
    samples = ["a b", " a  b ", "a\tb", "a \t b", "a\n\nb ", " a b", "", " ", "a   b c", "é  ü"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    one = F.trim(F.regexp_replace("s", text.WS + "+", " "))
    assert [r[0] for r in df.select(text.collapse_ws(F.col("s"))).collect()] == [r[0] for r in df.select(one).collect()]
    scripts = spark.createDataFrame([("plain", "en"), ("é", "fr"), ("அ", "en"), ("अ", "mr"), ("अ", "en"), (None, "de")], "t string, l string")
    assert [r[0] for r in scripts.select(text.detect_language(F.col("t"), F.col("l"))).collect()] == ["en", "fr", "ta", "mr", "hi", "de"]
    assert K.WS_CLASS.count(" ") == 1  # the plain space, which the runs that need no change consist of
