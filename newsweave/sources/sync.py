"""Synchronise stored articles with published snapshots: a resumable job of small steps, each of which happens once.

A snapshot is published in numbered parts (one JSON array of entries each) and listed in a manifest with the hash of every part.  The job keeps a cursor:
the snapshot it is in, the next part, and the counters of its sources so far as a map.  A step takes the next parts through

    verify -> admit -> insert or ignore -> counters -> (after the last part) newer-only source state and run rows -> cursor

and writes each result under its own step number; the cursor row comes last and makes the step count.  A step that was cut short leaves files
that no reader looks at, and is done again under the same number, so a job killed anywhere and started again gives the same tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave import constants as K
from newsweave.functions import url
from newsweave.operators import admission, articles, merge
from newsweave.operators.ranking import first_per_key
from newsweave.operators.story_index import cluster_increment
from newsweave.session import checkpointed, forget

ENTRY = "struct<source_id:string,company_id:string,title:string,url:string,text:string,published_at:timestamp,language:string,region:string>"
COUNTERS = "map<string,struct<inserted:bigint,duplicates:bigint>>"
CURSOR = f"step long, snapshot_id string, next_part int, done boolean, inserted long, counters {COUNTERS}, finished_at timestamp"
STATE = "source_id string, status string, error string, last_fetched_at timestamp"
RUN = "run_id string, snapshot_id string, source_id string, started_at timestamp, finished_at timestamp, status string, scanned long, matched long, inserted long, duplicates long, error string"
SNAPSHOT_STEPS = 16
TRUNCATED = "Snapshot size limit reached; some matching items were omitted."


class SnapshotRejected(ValueError):
    """The parts of a snapshot do not agree with the manifest; nothing of it was stored."""


def merge_counters(left: Column, right: Column) -> Column:
    """Sum of two counter maps; null counts as empty."""
    empty, none = F.create_map().cast(COUNTERS), F.lit(0).cast("bigint")
    add = lambda _, a, b: F.struct(*[(F.coalesce(a[c], none) + F.coalesce(b[c], none)).alias(c) for c in ("inserted", "duplicates")])
    return F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), add)


def count_outcomes(rows: DataFrame, by: list[str], source: str = "source_id", is_new: str = "is_new") -> DataFrame:
    """Counter map per group of `by`: inserted and duplicate rows of each source.  Counted before it is gathered, so a map has a row per source."""
    counted = rows.groupBy(*by, source).agg(F.sum(F.col(is_new).cast("long")).alias("inserted"), F.sum((~F.col(is_new)).cast("long")).alias("duplicates"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(source), F.struct("inserted", "duplicates"))))).cast(COUNTERS).alias("counters"))


def total_counters(log: DataFrame, step: str = "step", counters: str = "counters") -> DataFrame:
    """(source_id, inserted, duplicates) over a log of counter maps, one per step; a step that was delivered again, with the same map, counts once."""
    once = log.groupBy(step).agg(F.first(counters).alias(counters))
    rows = once.select(F.explode(counters).alias("source_id", "c"))
    return rows.groupBy("source_id").agg(F.sum("c.inserted").alias("inserted"), F.sum("c.duplicates").alias("duplicates"))


def part_hash(payload: Column) -> Column:
    """Hash over the exact bytes of a part."""
    return F.sha2(payload.cast("binary"), 256)


@dataclass
class SyncStore:
    """The tables of one folder, as of the last finished step."""

    spark: SparkSession
    folder: str

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def cursor(self):
        """Row of the last finished step, or None."""
        if not self._has("cursor"):
            return None
        return self.spark.read.schema(CURSOR).parquet(f"{self.folder}/cursor").orderBy(F.col("step").desc()).first()

    def read(self, name: str, schema, upto: int) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("step") <= upto).drop("step")

    def write(self, name: str, rows: DataFrame, step: int) -> None:
        rows.drop("step").write.mode("overwrite").parquet(f"{self.folder}/{name}/step={step}")

    def close(self, row: DataFrame, step: int) -> None:
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cursor/step={step}")

    def articles(self) -> DataFrame:
        last = self.cursor()
        return self._articles(last.step if last else -1)

    def _articles(self, upto: int) -> DataFrame:
        if not self._has("articles"):
            return self.spark.createDataFrame([], "company_id string, url string")
        return self.spark.read.parquet(f"{self.folder}/articles").where(F.col("step") <= upto).drop("step")

    def runs(self) -> DataFrame:
        last = self.cursor()
        return self.read("runs", f"{RUN}, step long", last.step if last else -1)

    def source_state(self, sources: DataFrame) -> DataFrame:
        """Stored state of the sources; before the first finished snapshot, that of the given table."""
        last = self.cursor()
        return self._state(sources, last.step if last else -1)

    def _state(self, sources: DataFrame, upto: int) -> DataFrame:
        given = sources.select("source_id", "status", F.col("error").cast("string").alias("error"), "last_fetched_at")
        if not self._has("source_state"):
            return given
        log = self.spark.read.schema(f"{STATE}, step long").parquet(f"{self.folder}/source_state").where(F.col("step") <= upto)
        stored = log.groupBy("source_id").agg(F.max_by(F.struct("status", "error", "last_fetched_at"), "step").alias("s"))
        return given.join(stored, "source_id", "left").select("source_id", *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "error", "last_fetched_at")])


def _verified(parts: DataFrame, manifest: DataFrame, target, now: Column, first: int = 0, last: int | None = None) -> tuple[int, object]:
    """Number of parts of a snapshot and its header; every part must be listed and there, the header must agree, and the parts from `first` to `last` must have their hash."""
    chosen = F.col("part").between(first, last) if last is not None else F.col("part") >= first
    listed = manifest.where(F.col("snapshot_id") == target.snapshot_id).select("part", "sha256", F.col("finished_at").alias("_finished"))
    stored = parts.where(F.col("snapshot_id") == target.snapshot_id).select("part", F.lit(True).alias("_there"), F.when(chosen, part_hash(F.col("payload"))).alias("_sha"), "started_at", "finished_at", "truncated")
    good = F.col("_there") & F.col("sha256").isNotNull() & (~chosen | (F.col("sha256") == F.col("_sha")))
    checked = listed.join(stored, "part", "full_outer").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("first"), F.max("part").alias("last"),
        F.bool_and(F.coalesce(good, F.lit(False))).alias("hashes"),
        F.bool_and(F.coalesce(F.col("finished_at") == F.col("_finished"), F.lit(False))).alias("header"),
        F.bool_or(F.col("finished_at") > now + F.expr(f"INTERVAL {K.FUTURE_SKEW_SECONDS} SECOND")).alias("future"),
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.bool_or("truncated").alias("truncated")).first()
    if not checked.hashes:
        raise SnapshotRejected(f"{target.snapshot_id}: a part is missing, is not listed or has another hash")
    if not checked.header or checked.first != 0 or checked.last != checked.n - 1:
        raise SnapshotRejected(f"{target.snapshot_id}: does not match its manifest")
    if checked.future:
        raise SnapshotRejected(f"{target.snapshot_id}: finishes in the future")
    return checked.n, checked


def _step_parts(n_parts: int, offset: int, parts_per_step: int) -> int:
    """Parts of the step that begins at `offset`: `parts_per_step` in the first, so that a job of one step takes what was asked for; later ones share the rest of a snapshot that would need over SNAPSHOT_STEPS steps."""
    if SNAPSHOT_STEPS < 2:
        return max(parts_per_step, n_parts)
    return max(parts_per_step, -(-(n_parts - parts_per_step) // (SNAPSHOT_STEPS - 1))) if offset else parts_per_step


def _planned(n_parts: int, offset: int, parts_per_step: int, max_steps: int | None) -> list[int]:
    """Where the next steps of a snapshot end, at most `max_steps` of them."""
    ends = []
    while offset < n_parts and (not max_steps or len(ends) < max_steps):
        offset = min(offset + _step_parts(n_parts, offset, parts_per_step), n_parts)
        ends.append(offset)
    return ends


def sync_steps(spark: SparkSession, folder: str, manifest: DataFrame, parts: DataFrame, results: DataFrame, sources: DataFrame, companies: DataFrame, seed_sources: DataFrame, seed_companies: DataFrame,
               now: Column, parts_per_step: int = 64, stories: bool = False, max_steps: int | None = None, **rules) -> Iterator[dict]:
    """Run the job step by step; each turn of the iterator is one finished step and gives {step, snapshot_id, done, inserted, pending}.

    `manifest`: snapshot_id, part, sha256, finished_at; `parts`: snapshot_id, part, payload, started_at, finished_at, truncated; `results`: snapshot_id, source_id, status, error, scanned,
    matched; `sources`: source_id, url, enabled, status, error, last_fetched_at.  Snapshots are taken in the order of their ids.  An entry goes in if its source is enabled
    and public, its company is public, its address is public, and the company is named in it.  A step takes `parts_per_step` parts; steps after the first take more where a snapshot would need over
    SNAPSHOT_STEPS steps: every step looks at the stored keys, so the number of steps must not grow with the snapshot.  With `stories`, new articles are assigned to stories in `folder`/stories.

    What the steps of a snapshot write is made for all of them at once, as far as `max_steps` reaches: of the entries of one key the first goes in, in whichever step it comes, so a step only writes its
    slice and its cursor row.  A job that was cut short makes the slices again from its cursor on."""
    store = SyncStore(spark, folder.rstrip("/"))
    taken = 0
    while not max_steps or taken < max_steps:
        last = store.cursor()
        step = last.step + 1 if last else 0
        completed = last.snapshot_id if last and last.done else None
        resumed = last is not None and not last.done
        queue = manifest.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_parts"))
        if last:
            queue = queue.where((F.col("snapshot_id") >= last.snapshot_id) if resumed else (F.col("snapshot_id") > completed))
        waiting = queue.agg(F.min("snapshot_id").alias("snapshot_id"), F.min_by("n_parts", "snapshot_id").alias("n_parts"), F.count(F.lit(1)).alias("n")).first()
        if not waiting.n:
            return
        offset = last.next_part if resumed else 0
        ends = _planned(waiting.n_parts, offset, parts_per_step, max_steps - taken if max_steps else None)
        # the first step of a snapshot checks all of its parts, a job that goes on with it those that it takes
        n_parts, header = _verified(parts, manifest, waiting, now, offset, ends[-1] - 1 if resumed else None)
        mine = parts.where((F.col("snapshot_id") == waiting.snapshot_id) & F.col("part").between(offset, ends[-1] - 1))

        step_of = sum((F.when(F.col("part") >= end, 1).otherwise(0) for end in ends[:-1]), F.lit(step)).cast("long")
        entries = mine.select("part", F.posexplode(F.from_json("payload", f"array<{ENTRY}>")).alias("pos", "entry")).select(
            F.format_string("%s-%08d-%08d", F.lit(waiting.snapshot_id), F.col("part"), F.col("pos")).alias("entry_id"), step_of.alias("step"), "entry.*")
        admitted = admission.snapshot_admit(entries, sources, companies, seed_sources, seed_companies).withColumn("canonical", url.canonical_url(F.col("url"))).where("canonical is not null")
        admitted = checkpointed(admitted, "sync-admitted")
        stored = store._articles(step - 1).select("company_id", F.col("url").alias("canonical"))
        # entry ids follow the parts, so the first entry of a key is also the first of its step
        fresh = merge.insert_ignore(stored, admitted.select("company_id", "canonical", "entry_id"), ["company_id", "canonical"], [F.col("entry_id")])
        marked = checkpointed(admitted.join(fresh.select("entry_id", "company_id", F.lit(True).alias("is_new")), ["entry_id", "company_id"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False))), "sync-marked")
        items = marked.where("is_new").withColumnRenamed("entry_id", "item_id").withColumn("fetched_at", F.lit(header.finished_at))
        built = articles.build_articles(items.drop("company_id", "is_new", "canonical", "step"), companies, pairs=items.select("item_id", "company_id"), **rules)
        built = checkpointed(built.join(items.select("item_id", "step").distinct(), "item_id"), "sync-articles")
        cursors = checkpointed(_cursors(spark, marked, waiting.snapshot_id, step, ends, n_parts, header, last.counters if resumed else None), "sync-cursors")
        inserted = {r.step: r.inserted for r in cursors.select("step", "inserted").collect()}  # one row a step

        for step, end in enumerate(ends, step):
            rows, row, done = built.where(F.col("step") == step), cursors.where(F.col("step") == step), end == n_parts
            store.write("articles", rows, step)
            if stories:
                cluster_increment(spark, f"{store.folder}/stories", store._articles(step).join(rows.select("item_id"), "item_id", "left_semi"), step)
            if done:
                _finish(store, step, waiting.snapshot_id, header, row, results, sources)
            store.close(row.drop("step"), step)
            taken += 1
            yield {"step": step, "snapshot_id": waiting.snapshot_id, "done": done, "inserted": inserted[step], "pending": waiting.n - int(done)}
        forget(admitted, marked, built, cursors)


def _cursors(spark: SparkSession, marked: DataFrame, snapshot_id: str, step: int, ends: list[int], n_parts: int, header, counters) -> DataFrame:
    """Cursor rows of the steps from `step` on, each with the counters of its snapshot so far: those of the steps before it and those given."""
    steps = spark.createDataFrame([(step + i, end, end == n_parts) for i, end in enumerate(ends)], "step long, next_part int, done boolean")
    own = count_outcomes(marked, ["step"]).select(F.col("step").alias("at"), F.explode("counters").alias("source_id", "c"))
    if counters:
        own = own.unionByName(spark.createDataFrame([(counters,)], f"counters {COUNTERS}").select(F.lit(step).cast("long").alias("at"), F.explode("counters").alias("source_id", "c")))
    total = steps.join(own, F.col("at") <= F.col("step")).groupBy("step", "source_id").agg(F.sum("c.inserted").alias("inserted"), F.sum("c.duplicates").alias("duplicates"))
    maps = total.groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", F.struct("inserted", "duplicates"))))).cast(COUNTERS).alias("counters"))
    fresh = marked.where("is_new").groupBy("step").agg(F.count(F.lit(1)).alias("inserted"))
    return steps.join(maps, "step", "left").join(fresh, "step", "left").select(
        "step", F.lit(snapshot_id).alias("snapshot_id"), "next_part", "done", F.coalesce("inserted", F.lit(0)).cast("long").alias("inserted"),
        F.coalesce("counters", F.create_map().cast(COUNTERS)).alias("counters"), F.lit(header.finished_at).alias("finished_at"))


def _finish(store: SyncStore, step: int, snapshot_id: str, header, row: DataFrame, results: DataFrame, sources: DataFrame) -> None:
    """After the last part: a run row per source of the snapshot, and the state of its enabled sources unless a newer one is stored."""
    own = results.where(F.col("snapshot_id") == snapshot_id).join(sources.where("enabled").select("source_id"), "source_id", "left_semi")
    counted = row.select(F.explode_outer("counters").alias("source_id", "c")).where("source_id is not null")
    partial = F.lit(bool(header.truncated))
    runs = own.join(counted, "source_id", "left").select(
        F.concat_ws(":", F.lit("scheduled"), F.lit(snapshot_id), "source_id").alias("run_id"), F.lit(snapshot_id).alias("snapshot_id"), "source_id",
        F.lit(header.started_at).alias("started_at"), F.lit(header.finished_at).alias("finished_at"),
        F.when(F.col("status") == "error", "error").when(partial, "partial").otherwise("success").alias("status"), F.col("scanned").cast("long").alias("scanned"), F.col("matched").cast("long").alias("matched"),
        F.coalesce("c.inserted", F.lit(0)).cast("long").alias("inserted"), F.coalesce("c.duplicates", F.lit(0)).cast("long").alias("duplicates"), F.coalesce("error", F.when(partial, TRUNCATED)).alias("error"))
    store.write("runs", runs, step)
    state = own.select("source_id", "status", F.col("error").cast("string").alias("error"), F.lit(header.finished_at).alias("last_fetched_at"))
    store.write("source_state", merge.update_newer(store._state(sources, step - 1), state, "source_id", "last_fetched_at", ["status", "error"]), step)


def snapshot_sync(spark: SparkSession, folder: str, *tables: DataFrame, max_steps: int | None = None, **how) -> SyncStore:
    """Run the job until no snapshot waits, or for `max_steps` steps; returns the tables."""
    for _ in sync_steps(spark, folder, *tables, max_steps=max_steps, **how):
        pass
    return SyncStore(spark, folder.rstrip("/"))


def backlog(store: SyncStore, manifest: DataFrame, parts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: snapshots that are not finished, parts and records of the one at work that wait, enabled sources whose last result is an error, and when the last finished snapshot ended."""
    last = store.cursor()
    waiting = manifest.select("snapshot_id").distinct()
    if last:
        waiting = waiting.where(F.col("snapshot_id") > last.snapshot_id) if last.done else waiting.where(F.col("snapshot_id") >= last.snapshot_id)
    current = waiting.agg(F.min("snapshot_id").alias("current"), F.count(F.lit(1)).alias("pending_snapshots"))  # one row
    done = last.next_part if last and not last.done else 0
    entries = F.size(F.from_json("payload", "array<struct<url:string>>")).cast("long")
    left = parts.where(F.col("part") >= done).join(current.select(F.col("current").alias("snapshot_id")), "snapshot_id").agg(F.count(F.lit(1)).alias("pending_parts"), F.coalesce(F.sum(entries), F.lit(0)).alias("pending_records"))
    failed = store.source_state(sources).join(sources.where("enabled").select("source_id"), "source_id", "left_semi").agg(F.coalesce(F.sum((F.col("status") == "error").cast("long")), F.lit(0)).alias("failed_sources"))
    finished = store.runs().agg(F.max("finished_at").alias("last_finished_at"))
    return current.drop("current").crossJoin(left).crossJoin(failed).crossJoin(finished)
