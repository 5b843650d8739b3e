"""Block search and hard negatives against brute force: blocks of every size, ties, copies, odd vectors, extra columns, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import block_search, hard_negatives
from newsweave.llm.cells import BestLists

SCHEMA = "vec_id long, embedding array<float>, label int, `{}` string"


def usable(rows):
    """Rows as the operators define them: valid, and one per id."""
    kept = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.setdefault(vec_id, []).append((label, [float(np.float32(x)) for x in vector]))
    return kept


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def nearest_brute(rows, step, k):
    vectors = {i: min(v for _, v in found) for i, found in ((i, [x for x in f if any(x[1])]) for i, f in usable(rows).items()) if found}
    out = []
    for q in sorted(i for i in vectors if i % step == 0):
        hits = sorted((-product(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(hits[:k], 1)]
    return out


def negatives_brute(rows, step, low, high, k=5):
    whole = {}
    for i, found in usable(rows).items():
        found = [(label, [math.floor(256 * x) for x in v]) for label, v in found if label is not None]
        found = [x for x in found if sum(y * y for y in x[1]) < 2**55]
        if found:
            whole[i] = min(found)
    out = []
    for a in sorted(i for i in whole if i % step == 0):
        label, anchor = whole[a]
        scored = [(-sum(x * y for x, y in zip(anchor, v)), i, other) for i, (other, v) in whole.items() if i != a and len(v) == len(anchor)]
        for p, i, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fits = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            out += [(a, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits[:k], 1)]
    return out


def random_rows(n, seed, odd=True):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.randrange(3), "x") for i in range(n)]
    for i in range(0, n, 3):  # a third are copies of one vector
        rows[i] = (i, rows[0][1], rows[i][2], "x")
    for i in range(1, n, 5):  # coarse numbers give ties between different vectors
        rows[i] = (i, [float(round(x)) for x in rows[i][1]], rows[i][2], None)
    if odd:
        rows += [(n + 1, None, 1, "x"), (n + 2, [], 1, "x"), (n + 3, [1.0, None] * 4, 1, "x"), (n + 4, [math.nan] * 8, 1, "x"), (n + 5, [math.inf] * 8, 1, "x"), (n + 6, [0.0] * 8, 1, "x"), (None, [1.0] * 8, 1, "x")]
        rows += [(2 * n, [1.0, 2.0, 3.0], 1, "x"), (2 * n + 1, [3.0, 2.0, 1.0], 1, "x"), (2 * n + 2, [3.0, 2.0, 1.5], 2, "x"), (4 * n, [5.0], 2, "x"), (5, [9.0] * 8, 0, "x"), rows[7], (6 * n, [1e30, -1e30] * 4, 1, "x"), (6 * n + 1, [1e-40] * 8, 1, "x"), (10 * n, [1.0] * 8, None, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("query_block,row_block,k", [(1_024, 16_384, 20), (7, 30, 3), (1, 400, 1)])
def test_block_search_equals_brute_force(spark, query_block, row_block, k, monkeypatch):
    rows = random_rows(300, 5)
    table = spark.createDataFrame(rows, SCHEMA.format("score")).repartition(4, "label")
    found = block_search.nearest(table, F.col("vec_id") % 20 == 0, k, query_block=query_block, row_block=row_block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == nearest_brute(rows, 20, k)


def test_block_search_on_given_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, block_search.nearest(table, F.col("vec_id") % 20 == 0).collect())) == nearest_brute(rows, 20, 20)


def test_bounds_hold_and_most_pairs_are_dropped():
    rng = np.random.default_rng(3)
    for dimension, spread in ((64, 1.0), (3, 1e20), (2_500, 1e-20)):
        q, x = rng.normal(size=(40, dimension)) * spread, rng.normal(size=(500, dimension)) * np.exp(rng.normal(size=(500, 1)) * 2)
        low, high = block_search.bounds(block_search.quantise(q), block_search.quantise(x))
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
    unit = rng.normal(size=(20_000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    low, high = block_search.bounds(block_search.quantise(unit[:50]), block_search.quantise(unit))
    floor = np.sort(low, axis=1)[:, -21]
    assert (high >= floor[:, None]).sum() < 50 * 21 * 5


def test_best_lists_keep_the_smallest_ids_of_ties():
    best = BestLists(2, 3, np.int64)
    best.offer(np.array([1, 1, 0]), np.array([5, 5, -7]), np.array([9, 4, 1]))
    best.offer(np.array([1, 1]), np.array([5, 6]), np.array([2, 8]))
    ids, scores = best.lists()
    assert [x.tolist() for x in ids] == [[1], [8, 2, 4]] and [x.tolist() for x in scores] == [[-7], [6, 5, 5]]


@pytest.mark.parametrize("anchor_block,row_block,directions,whole", [(256, 16_384, 8, 0.05), (3, 40, 2, 2.0), (5, 400, 0, 0.0)])
def test_hard_negatives_equal_brute_force(spark, anchor_block, row_block, directions, whole, monkeypatch):
    rows = random_rows(300, 11)
    table = spark.createDataFrame(rows, SCHEMA.format("rank")).repartition(4, "label")
    for low, high in ((80, 100), (10, 90)):
        found = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, low=low, high=high, anchor_block=anchor_block, row_block=row_block, directions=directions)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, found.collect())) == sorted(negatives_brute(rows, 10, low, high))


@pytest.mark.parametrize("whole_tile", [0.0, 2.0])
def test_angle_bounds_hold_and_both_ways_of_scoring_agree(whole_tile, monkeypatch):
    monkeypatch.setattr(hard_negatives, "WHOLE_TILE", whole_tile)
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (5, 16))
    v = np.concatenate([centres[rng.integers(0, 5, 300)] + rng.integers(-60, 60, (300, 16)), np.zeros((1, 16), int), centres])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(len(v))), "label": [0] * len(v), "vector": pa.array(v.tolist(), pa.list_(pa.int32()))})
    stored = next(hard_negatives._angles([c.tolist() for c in centres])(iter([batch])))
    side = hard_negatives.Side(stored, np.arange(len(v)), v)
    low, high = hard_negatives.score_bounds(side, side)
    true = v @ v.T
    assert (low <= true).all() and (true <= high).all()
    near = high >= 0.8 * np.outer(side.norms, side.norms)
    assert near.mean() < 0.6  # clustered vectors: the directions tell the clusters apart
    rows, columns, scores = hard_negatives.scores_where(side, side, near)
    assert (scores == true[rows, columns]).all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA.format("extra"))
    assert block_search.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    only = spark.createDataFrame([(20, [1.0, 2.0], 1, "x")], SCHEMA.format("extra"))
    assert block_search.nearest(only, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(only, F.col("vec_id") % 20 == 0).count() == 0
