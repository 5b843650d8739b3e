"""Stories that grow: a batch of new articles is assigned to stored stories through an index, without reading stored texts.

The store is a folder of tables, each divided by batch; a batch overwrites its own part and reads only the parts before it, so a batch that is
replayed after a failure gives the same tables.

* `titles`, `tokens`: the distinct titles of a company and three-day bucket (title nodes) and their prefix tokens (the probe key is company, token, bucket);
* `texts`: sketches and token sets of texts by the same bucket; sketches meet in cells of bounded size (`operators/similar.py`), sets are read only for pairs that may pass;
* `members`: arrival and event time of every article by content, without texts;
* `parents`: an append-only log of each article's best parent; a later row replaces an earlier one only if it is better;
* `roots`: an append-only log of the story of each article.

Articles may arrive in any order.  Most batches arrive after everything stored; then stored articles keep their parents, and only the new
ones are resolved, from the stored roots of their parents.  A batch with late arrivals also offers its articles as parents to stored ones,
and the stories that this touches are resolved again.

The order of prefix tokens must stay as it is for the filter to be exact, so token frequencies are those of the first batch; tokens that it lacks count as rarest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import text
from newsweave.operators import similar
from newsweave.operators.clustering import HOT_KEY_ROWS, event_time, resolve_roots
from newsweave.operators.ranking import newest, running_min
from newsweave.session import checkpointed

BUCKETS = 8  # parts of a batch that are read by key
_EPSILON = similar.EPSILON
ARRIVAL = "struct<fetched_at:timestamp,article_id:string>"
BEST = "struct<t:bigint,fetched_at:timestamp,article_id:string>"
TABLES = {
    "order": "token string, n bigint",
    "titles": "node string, title_set array<string>",
    "tokens": "company_id string, token string, node string, title_size int, place int",
    "texts": "variant string, node string, content_hash string, published_at timestamp, text_size int, sketch binary, text_set array<string>",
    "members": f"company_id string, content_hash string, variant string, own {BEST}",
    "parents": f"article_id string, best {BEST}",
    "roots": "article_id string, cluster_id string",
    "span": f"first {ARRIVAL}, last {ARRIVAL}",
}


def _bucket_of(name: str) -> Column | None:
    if name in ("titles", "tokens", "texts"):
        return None  # the three-day bucket, already a column
    key = {"members": "content_hash", "parents": "article_id", "roots": "article_id"}.get(name)
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("long") if key else F.lit(0).cast("long")


class StoryStore:
    """The tables of one folder as they stand before, or with, a batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str, before: int, buckets: list[int] | None = None) -> DataFrame:
        schema = f"{TABLES[name]}, batch long, bucket long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("batch") < before)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        bucket = _bucket_of(name)
        rows = rows if bucket is None else rows.withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={batch_id}")


def _some(rows: DataFrame, column: str | Column, name: str = "bucket") -> list[int]:
    """The distinct buckets of a batch: few hash buckets, or its three-day spans."""
    return [r[name] for r in rows.select(column if isinstance(column, str) else column.alias(name)).distinct().collect()]


def _slim(articles: DataFrame) -> DataFrame:
    """The batch without its texts."""
    titles = F.array_sort(text.token_set(F.col("title")))
    own = F.struct(newest(event_time()).alias("t"), F.col("fetched_at"), F.col("article_id"))
    variant = F.sha2(F.concat_ws("|", "company_id", "content_hash", F.unix_micros("published_at").cast("string"), F.array_join("title_set", " ")), 256)
    day = F.floor(F.unix_seconds("published_at") / F.lit(K.STORY_DAYS * 86_400)).cast("long")
    return articles.select("article_id", "company_id", "content_hash", "published_at", titles.alias("title_set"), own.alias("own")).select(
        "*", F.when(F.col("published_at").isNotNull(), variant).alias("variant"), day.alias("bucket"))


def _prefixes(variants: DataFrame, order: DataFrame) -> DataFrame:
    """Variants with the rarest tokens of their titles, by the stored frequencies: titles that reach the threshold share one of them."""
    words = variants.select("variant", F.explode("title_set").alias("token")).join(order.select("token", "n"), "token", "left")
    ranked = words.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token")))).alias("s"))
    keep = F.size("s") - F.ceil(F.size("s") * K.TITLE_JACCARD - _EPSILON).cast("int") + 1
    return variants.join(ranked.select("variant", F.transform(F.slice("s", 1, keep), lambda x: x["token"]).alias("prefix")), "variant")


def _similar(asked: DataFrame, titles: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(variant, other, published_at, other_published_at): stored variants that report the same story as one of the asked."""
    nodes = asked.groupBy("company_id", "bucket", "node").agg(F.first("title_set").alias("title_set"), F.first("prefix").alias("prefix")).withColumn("title_size", F.size("title_set"))
    nodes = checkpointed(nodes, "story-nodes")
    alike = similar.confirmed_titles(similar.title_candidates(similar.title_postings(nodes), tokens, (-1, 0, 1)), nodes, titles)
    repeated = texts.groupBy("node").count().where("count > 1").join(nodes, "node", "left_semi")
    pairs = checkpointed(alike.unionByName(repeated.select(F.col("node").alias("left_node"), F.col("node").alias("right_node"))), "story-titles")
    sketches = texts.select("variant", "node", "content_hash", "published_at", "text_size", "sketch")
    right = checkpointed(sketches.join(pairs.select(F.col("right_node").alias("node")).distinct(), "node", "left_semi"), "story-sketches")
    left = checkpointed(sketches.join(pairs.select(F.col("left_node").alias("node")).distinct(), "node", "left_semi").join(asked.select("variant"), "variant", "left_semi"), "story-sketches")
    found = checkpointed(similar.text_candidates(pairs, left, right, HOT_KEY_ROWS), "story-candidates")
    side = lambda name, rows: texts.select(F.col("variant").alias(f"{name}_variant"), F.col("published_at").alias(f"{name}_published_at"), F.col("text_set").alias(f"{name}_text")).join(rows.select(f"{name}_variant").distinct(), f"{name}_variant", "left_semi")
    return found.join(side("left", found), "left_variant").join(side("right", found), "right_variant").where(text.jaccard(F.col("left_text"), F.col("right_text")) >= K.TEXT_JACCARD).select(
        F.col("left_variant").alias("variant"), F.col("left_published_at").alias("published_at"), F.col("right_variant").alias("other"), F.col("right_published_at").alias("other_published_at"))


def _arrival(own: str = "own") -> Column:
    return F.struct(F.col(f"{own}.fetched_at").alias("fetched_at"), F.col(f"{own}.article_id").alias("article_id"))


def _by_content(new: DataFrame, stored: DataFrame, late: bool) -> DataFrame:
    """(article_id, candidate) of articles whose text arrived before: the best of all earlier rows of the text.  Stored rows of a text take part as one row, the best of them, unless the batch has late arrivals."""
    key = ["company_id", "content_hash"]
    old = stored.select(*key, "own").join(new.select(*key).distinct(), key, "left_semi")
    if not late:
        old = old.groupBy(*key).agg(F.min("own").alias("own"), F.max(_arrival()).alias("arrival"))
    else:
        old = old.withColumn("arrival", _arrival())
    rows = new.select(*key, "own", _arrival().alias("arrival")).unionByName(old)
    repeated = rows.groupBy(*key).count().where("count > 1").select(*key)
    levels = [F.date_trunc("hour", "arrival.fetched_at"), F.date_trunc("second", "arrival.fetched_at"), F.struct("arrival.fetched_at", F.substring("arrival.article_id", 1, 3))]
    table = checkpointed(rows.join(repeated, key, "left_semi"), "repeated-contents")
    running = running_min(table, key, "own", levels, [F.col("arrival")], "candidate").where("candidate is not null")
    return (running if late else running.where(_arrival() == F.col("arrival"))).select(F.col("own.article_id").alias("article_id"), "candidate")


def _prefer(published: str, first: str) -> Column:
    return F.struct(newest(F.col(published)).alias("t"), F.col(f"{first}.fetched_at").alias("fetched_at"), F.col(f"{first}.article_id").alias("article_id"))


def cluster_increment(spark: SparkSession, folder: str, articles: DataFrame, batch_id: int) -> DataFrame:
    """Add a batch of articles to the stories in `folder` and return (article_id, cluster_id) of the articles whose story is new or has changed.

    Batches are numbered from 0; a replay passes the same number and articles.  Articles, stored ones included, are told apart by `article_id`; rows already
    stored by an earlier batch must not be passed again."""
    store = StoryStore(spark, folder)
    batch = checkpointed(_slim(articles), "story-batch")
    new = batch.select("article_id", "company_id", "content_hash", "variant", "own")
    span = batch.agg(F.min(_arrival()).alias("first"), F.max(_arrival()).alias("last")).where("first is not null")
    stored_last = store.read("span", batch_id).agg(F.max("last").alias("stored"))
    late = not span.crossJoin(stored_last).where("first <= stored").isEmpty()  # one row each

    # the index takes the batch
    variants = batch.where("variant is not null").groupBy("variant").agg(*[F.first(c).alias(c) for c in ("company_id", "content_hash", "published_at", "title_set", "bucket")], F.min(_arrival()).alias("arrival"))
    variants = checkpointed(variants.withColumn("node", similar.title_node(F.col("title_set"))), "story-variants")
    if batch_id == 0:
        words = variants.select(F.explode("title_set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        store.write("order", words, 0)
    asked = checkpointed(_prefixes(variants.drop("arrival"), store.read("order", 1)), "story-probes")
    days = _some(variants, "bucket")
    near = sorted({d + step for d in days for step in (-1, 0, 1)})
    known = store.read("texts", batch_id, days).select("variant")
    fresh = variants.join(known, "variant", "left_anti").select("variant", "node", "content_hash", "published_at", "bucket", F.col("arrival.article_id").alias("article_id"))
    sets = fresh.join(articles.select("article_id", text.token_set(F.col("text")).alias("text_set")), "article_id")
    store.write("texts", similar.sketched(sets).select("variant", "node", "content_hash", "published_at", "text_size", "sketch", "text_set", "bucket"), batch_id)
    new_nodes = asked.join(store.read("titles", batch_id, days).select("node"), "node", "left_anti").groupBy("company_id", "bucket", "node").agg(F.first("title_set").alias("title_set"), F.first("prefix").alias("prefix"))
    new_nodes = checkpointed(new_nodes, "story-nodes")
    store.write("titles", new_nodes.select("node", "title_set", "bucket"), batch_id)
    store.write("tokens", similar.title_postings(new_nodes.withColumn("title_size", F.size("title_set"))).select("company_id", "token", "node", "title_size", "place", "bucket"), batch_id)
    store.write("members", new.drop("article_id"), batch_id)
    store.write("span", span, batch_id)

    # candidates of the new articles, and, if some arrived late, of stored ones
    reports = checkpointed(_similar(asked, *[store.read(name, batch_id + 1, near) for name in ("titles", "tokens", "texts")]), "story-pairs")
    others = reports.select(F.col("other").alias("variant")).distinct()
    members = store.read("members", batch_id + 1)  # narrow: no texts
    of_others = checkpointed(members.where("variant is not null").join(others, "variant", "left_semi").select("variant", "own", "batch"), "story-members")
    first = of_others.groupBy(F.col("variant").alias("other")).agg(F.min(_arrival()).alias("first"))
    neighbours = reports.join(first, "other").select("variant", _prefer("other_published_at", "first").alias("candidate"))
    earlier = F.struct("candidate.fetched_at", "candidate.article_id")
    candidates = new.select("article_id", "variant", "own").join(neighbours, "variant").where(earlier < _arrival()).select("article_id", "candidate")
    hashed = _some(batch, F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("long"))
    candidates = candidates.unionByName(_by_content(new, store.read("members", batch_id, hashed), late))
    if late:
        offered = reports.join(variants.select("variant", "arrival"), "variant").select(F.col("other").alias("variant"), _prefer("published_at", "arrival").alias("candidate"))
        stored = of_others.where(F.col("batch") < batch_id).select("variant", "own")
        candidates = candidates.unionByName(stored.join(offered, "variant").where(earlier < _arrival()).select(F.col("own.article_id").alias("article_id"), "candidate"))
    everyone = new.select("article_id", F.lit(None).cast(BEST).alias("candidate")).unionByName(candidates.select("article_id", F.col("candidate").cast(BEST).alias("candidate")))
    best = checkpointed(everyone.groupBy("article_id").agg(F.min("candidate").alias("best")), "story-best")
    if late:  # a stored article appears only if the batch has a better parent for it
        current = store.read("parents", batch_id).groupBy("article_id").agg(F.min("best").alias("current"))
        kept = best.join(current, "article_id", "left").join(new.select("article_id", F.lit(True).alias("is_new")), "article_id", "left")
        best = checkpointed(kept.where(F.col("is_new") | (F.col("best").isNotNull() & (F.col("current").isNull() | (F.col("best") < F.col("current"))))).select("article_id", "best"), "story-best")
    store.write("parents", best, batch_id)

    # stories of the new articles, and of all articles of a touched story
    links = best.select("article_id", F.col("best.article_id").alias("parent_id"))
    roots = stored_stories(spark, folder, batch_id)
    if late:
        changed = links.join(new.select("article_id"), "article_id", "left_anti")
        touched = roots.join(changed.select("article_id"), "article_id", "left_semi").select("cluster_id").distinct()
        again = roots.join(touched, "cluster_id", "left_semi").select("article_id")
        links_again = store.read("parents", batch_id + 1).join(again, "article_id", "left_semi").groupBy("article_id").agg(F.min("best").alias("best"))
        links = checkpointed(links.join(again, "article_id", "left_anti").unionByName(links_again.select("article_id", F.col("best.article_id").alias("parent_id"))), "story-links")
    inside = links.select(F.col("article_id").alias("parent_id"), F.lit(True).alias("inside"))
    asked_roots = links.select(F.col("parent_id").alias("article_id")).distinct()
    outside = roots.join(asked_roots, "article_id", "left_semi").select(F.col("article_id").alias("parent_id"), F.col("cluster_id").alias("story"))
    placed = checkpointed(links.join(inside, "parent_id", "left").join(outside, "parent_id", "left"), "story-links")
    resolved = resolve_roots(placed.select("article_id", F.when(F.col("inside"), F.col("parent_id")).alias("parent_id")))
    entry = placed.where("inside is null and story is not null").select(F.col("article_id").alias("cluster_id"), "story")
    found = resolved.join(entry, "cluster_id", "left").select("article_id", F.coalesce("story", "cluster_id").alias("cluster_id"))
    if late:
        found = found.join(roots, ["article_id", "cluster_id"], "left_anti")
    store.write("roots", found, batch_id)
    return store.read("roots", batch_id + 1).where(F.col("batch") == batch_id).select("article_id", "cluster_id")


def stored_stories(spark: SparkSession, folder: str, before: int = (1 << 62)) -> DataFrame:
    """(article_id, cluster_id) as of all batches before the given one."""
    log = StoryStore(spark, folder).read("roots", before)
    return log.groupBy("article_id").agg(F.max_by("cluster_id", "batch").alias("cluster_id"))
