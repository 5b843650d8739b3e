"""The number of steps of a snapshot is bounded; each step verifies the parts that it takes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsweave.session import scratch_path
from newsweave.sources import sync
from test_incremental import DAY, published


def test_steps_of_a_snapshot_are_bounded(spark, monkeypatch):
    tables, now = published(spark), F.lit(DAY + dt.timedelta(days=2))
    monkeypatch.setattr(sync, "SNAPSHOT_STEPS", 1)
    steps = list(sync.sync_steps(spark, folder := scratch_path(spark, "sync"), *tables, now=now, parts_per_step=1))
    snapshots = sorted(r.snapshot_id for r in tables[0].select("snapshot_id").distinct().collect())
    assert [s["snapshot_id"] for s in steps] == snapshots and all(s["done"] for s in steps) and tables[0].count() > len(snapshots)
    stored = sync.SyncStore(spark, folder)
    assert [r.url for r in stored.articles().orderBy("company_id", "url").collect()] == [f"https://news.example.com/{n}" for n in (1, 2, 1, 3)]
    runs = {(r.snapshot_id, r.source_id): (r.inserted, r.duplicates) for r in stored.runs().collect()}
    assert runs["p1", "s1"] == (3, 1) and runs["p2", "s1"] == (1, 1)


def test_later_steps_verify_their_parts(spark):
    manifest, parts, *rest = published(spark)
    how = {"now": F.lit(DAY + dt.timedelta(days=2)), "parts_per_step": 1}
    folder = scratch_path(spark, "sync")
    sync.snapshot_sync(spark, folder, manifest, parts, *rest, max_steps=1, **how)
    with pytest.raises(sync.SnapshotRejected):
        sync.snapshot_sync(spark, folder, manifest, parts.withColumn("payload", F.when(F.col("part") == 1, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))), *rest, **how)
    assert sync.SyncStore(spark, folder).cursor().step == 0


@pytest.mark.parametrize("n_parts", [1, 2, 17, 31, 32, 33, 171, 5_000])
def test_first_step_takes_what_was_asked_for(n_parts):
    at, sizes = 0, []
    while at < n_parts:
        sizes.append(sync._step_parts(n_parts, at, 2))
        at += sizes[-1]
    assert sizes[0] == 2 and min(sizes) >= 2 and len(sizes) <= sync.SNAPSHOT_STEPS


def test_first_step_of_a_large_snapshot(spark, monkeypatch):
    manifest, parts, *rest = published(spark)
    numbered = lambda df: df.where("snapshot_id = 'p2'").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(4))))
    monkeypatch.setattr(sync, "SNAPSHOT_STEPS", 2)
    steps = list(sync.sync_steps(spark, folder := scratch_path(spark, "sync"), numbered(manifest), numbered(parts), *rest, now=F.lit(DAY + dt.timedelta(days=2)), parts_per_step=1))
    taken = [r.next_part for r in spark.read.parquet(f"{folder}/cursor").orderBy("step").collect()]
    assert taken == [1, 5] and [s["done"] for s in steps] == [False, True]


def test_entries_of_a_snapshot_are_admitted_once(spark, monkeypatch):
    tables, calls, admit = published(spark), [], sync.admission.snapshot_admit
    monkeypatch.setattr(sync.admission, "snapshot_admit", lambda *args: calls.append(1) or admit(*args))
    steps = list(sync.sync_steps(spark, scratch_path(spark, "sync"), *tables, now=F.lit(DAY + dt.timedelta(days=2)), parts_per_step=1))
    assert len(steps) == 3 and len(calls) == 2  # two snapshots, the first of two parts
