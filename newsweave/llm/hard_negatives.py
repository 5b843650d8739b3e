"""Hard negatives of anchors: rows of another label whose score lies in a window below that of a positive; found by angular triangle filtering.

Components become whole numbers, so scores are exact 64-bit inner products.  Every row stores its angles to a few reference directions.  For
an anchor a and a row x, each direction r bounds their angle: |ar - xr| <= ax <= min(ar + xr, 2 pi - ar - xr).  The cosines of the
tightest bounds, times both lengths, widened for rounding, bound the score.  Positives need an upper bound that reaches the anchor's
k-th best score so far; negatives need bounds that overlap a positive's window, and an upper bound that reaches the k-th best score
found in it.  Only such pairs are scored.  Where most pairs of a tile go on, the tile is one matrix product of doubles (exact below 2**53).

Two passes of the same join: anchors against the rows of their label give the positives; anchors with their windows against the rows of other labels
give the negatives.  Rows are dealt by hash of the id, so a label may hold any share of them.

Defined results: rows without id, label or vector, with an empty vector, or with a null or non-finite component take no part, nor do rows whose whole-number vector has a
squared length of 2**55 or more (their scores could leave 64 bits); rows that repeat an id count once, the smallest by label, then vector;
vectors of different lengths have no score; equal scores go by smaller id; of equal vectors of one label only the k + 1 smallest ids can be in a
list, and the others are left out; an anchor without positives, and a positive without negatives, has no rows; an empty table gives an empty result; other
columns play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.cells import BestLists, by_length, cells, in_cells, is_usable, kth_largest, merged
from newsweave.session import checkpointed

ANCHOR_BLOCK = 256
ROW_BLOCK = 16_384  # rows of a cell
TILE = 1_024  # rows of a tile
DIRECTIONS = 8  # reference directions: a bounded sample of rows, of any use only where angles to them differ
WHOLE_TILE = 0.05  # share of pairs above which a tile is scored whole
ANGLE_ROUNDING = 1e-7  # of an arc cosine near 0 or pi
PAIRS = 1 << 18  # pairs that are scored one by one at a time
EXACT_DOUBLE = float(1 << 53)
LONGEST_SQUARE = float(1 << 55)


def _angles(directions: list[list[int]]):
    """Adds the length of each vector and its angles to the directions of its number of components."""

    def run(batches):
        for batch in batches:
            norms, angles = np.zeros(batch.num_rows), [None] * batch.num_rows
            for n, at, v in by_length(batch.column("vector"), np.float64):
                r = np.array([d for d in directions if len(d) == n], np.float64).reshape(-1, n)
                r = r[np.linalg.norm(r, axis=1) > 0]
                norms[at] = np.linalg.norm(v, axis=1)
                cosine = (v @ r.T) / np.maximum(np.outer(norms[at], np.linalg.norm(r, axis=1)), 1e-300)
                for i, row in zip(at, np.arccos(np.clip(cosine, -1, 1))):
                    angles[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array(norms), pa.array(angles, pa.list_(pa.float64()))], names=["vec_id", "label", "vector", "norm", "angles"])

    return run


class Side:
    """The vectors of one length of a block of anchors or rows."""

    def __init__(self, batch, at: np.ndarray, vectors: np.ndarray):
        column = lambda c: batch.column(c).to_numpy()[at]
        angles = batch.column("angles").take(pa.array(at))
        angles = (angles.combine_chunks() if isinstance(angles, pa.ChunkedArray) else angles).flatten().to_numpy()
        self.at, self.vectors, self.ids, self.labels, self.norms, self.angles = at, vectors, column("vec_id"), column("label"), column("norm"), angles.reshape(len(at), -1)

    def part(self, where) -> Side:
        new = object.__new__(Side)
        for name, value in vars(self).items():
            setattr(new, name, value[where])
        return new


def score_bounds(a: Side, x: Side) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, from the triangle inequality of angles."""
    least, most = np.zeros((len(a.ids), len(x.ids))), np.full((len(a.ids), len(x.ids)), math.pi)
    for j in range(a.angles.shape[1]):
        ar, xr = a.angles[:, j, None], x.angles[None, :, j]
        np.maximum(least, np.abs(ar - xr), out=least)
        both = ar + xr
        np.minimum(most, np.minimum(both, 2 * math.pi - both), out=most)
    lengths = np.outer(a.norms, x.norms)
    slack = 1 + 1e-9 * lengths
    return lengths * np.cos(np.minimum(most + ANGLE_ROUNDING, math.pi)) - slack, lengths * np.cos(np.maximum(least - ANGLE_ROUNDING, 0)) + slack


def scores_where(a: Side, x: Side, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs."""
    rows, columns = np.nonzero(wanted)
    if not len(rows):
        return rows, columns, rows.astype(np.int64)
    if len(rows) > WHOLE_TILE * wanted.size and a.norms.max() * x.norms.max() < EXACT_DOUBLE:
        return rows, columns, (a.vectors.astype(np.float64) @ x.vectors.T.astype(np.float64))[rows, columns].astype(np.int64)
    parts = [np.einsum("ij,ij->i", a.vectors[rows[at : at + PAIRS]], x.vectors[columns[at : at + PAIRS]]) for at in range(0, len(rows), PAIRS)]
    return rows, columns, np.concatenate(parts)


def _tiles(anchors: dict[int, Side], parts) -> Iterator[tuple[Side, Side]]:
    for part in parts:
        for n, at, vectors in by_length(part.column("vector"), np.int64):
            if n in anchors:
                rows = Side(part, at, vectors)
                for a in range(0, len(at), TILE):
                    yield anchors[n], rows.part(slice(a, a + TILE))


def _cells_of(batches) -> Iterator[tuple[pa.Table, Iterator[tuple[Side, Side]]]]:
    """For each cell with both sides its anchors, and pairs of (anchors, a tile of rows) of one vector length."""
    for cell in cells(batches):
        asked, first = [], None
        for kind, part in cell:
            if kind:
                first = part
                break
            asked.append(part)
        if asked and first is not None:
            table = pa.Table.from_batches(asked)
            sides = {n: Side(table, at, v) for n, at, v in by_length(table.column("vector"), np.int64)}
            yield table, _tiles(sides, chain([first], (part for _, part in cell)))


def _lists(**columns) -> pa.RecordBatch:
    whole = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({name: pa.array(v, whole if name in ("ids", "scores") else pa.int64()) for name, v in columns.items()})


def _positives(k: int):
    def run(batches):
        for table, tiles in _cells_of(batches):
            best = BestLists(table.num_rows, k, np.int64)
            for a, x in tiles:
                for label in np.intersect1d(a.labels, x.labels):
                    own, other = a.part(a.labels == label), x.part(x.labels == label)
                    low, high = score_bounds(own, other)
                    not_self = own.ids[:, None] != other.ids
                    floor = best.floor[own.at].astype(np.float64)
                    if (floor <= float(best.lowest)).any():
                        floor = np.maximum(floor, kth_largest(np.where(not_self, low, -np.inf), k, -np.inf))
                    rows, columns, scores = scores_where(own, other, not_self & (high >= floor[:, None]))
                    if len(rows):
                        best.offer(own.at[rows], scores, other.ids[columns])
            ids, scores = best.lists()
            yield _lists(anchor_id=table.column("vec_id").to_numpy(), ids=ids, scores=scores)

    return run


def window(positive_score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score with low * p <= 100 * n <= high * p."""
    return -((-low * positive_score) // 100), (high * positive_score) // 100


def _negatives(k: int, positives: int, low: int, high: int):
    def run(batches):
        for table, tiles in _cells_of(batches):
            given = table.column("positive_scores").to_pylist()
            least, most = window(np.array([[*s, *[-1] * (positives - len(s))] for s in given], np.int64), low, high)  # a score below 0 has an empty window
            best = BestLists(least.size, k, np.int64)
            for a, x in tiles:
                lower, upper = score_bounds(a, x)
                wanted = np.zeros(lower.shape, bool)
                for p in range(positives):
                    reach = np.maximum(least[a.at, p], best.floor[a.at * positives + p])
                    wanted |= (upper >= reach[:, None]) & (lower <= most[a.at, p, None])
                wanted &= a.labels[:, None] != x.labels
                rows, columns, scores = scores_where(a, x, wanted)
                at = a.at[rows]
                for p in range(positives):
                    fits = (scores <= most[at, p]) & (scores >= least[at, p]) & (scores >= best.floor[at * positives + p])
                    if fits.any():
                        best.offer(at[fits] * positives + p, scores[fits], x.ids[columns[fits]])
            ids, scores = best.lists()
            full = np.flatnonzero([len(x) > 0 for x in ids])
            yield _lists(anchor_id=table.column("vec_id").to_numpy()[full // positives], place=full % positives, ids=[ids[i] for i in full], scores=[scores[i] for i in full])

    return run


def whole_numbers(vector: str, factor: int) -> Column:
    """floor(factor * x) for each component x as a double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, directions: int = DIRECTIONS) -> DataFrame:
    """For each row that `is_anchor` (a condition on `vec_id`) selects and each of its first `positives` other rows of the same label: the first `negatives` rows of other labels whose score n
    satisfies low * p <= 100 * n <= high * p, p being the positive's score.  Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    usable = given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_usable("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    whole = usable.withColumn("vector", whole_numbers("vector", factor)).filter(square < LONGEST_SQUARE).withColumn("vector", F.col("vector").cast("array<int>"))
    first = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    ids = checkpointed(first, "vectors")
    sample = [r.vector for r in ids.orderBy(F.xxhash64("vec_id"), "vec_id").limit(directions).collect()]
    stored = checkpointed(ids.mapInArrow(_angles(sample), "vec_id long, label long, vector array<int>, norm double, angles array<double>"), "angles")
    copies = Window.partitionBy("same", "vector", "label").orderBy("vec_id")
    most = max(positives, negatives) + 1
    rows = stored.withColumn("same", F.xxhash64("vector", "label")).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= most).drop("same", "copy")
    anchors = stored.filter(is_anchor)
    n_anchors, n_rows = anchors.count(), stored.count()

    met = in_cells(anchors, rows, "vec_id", n_anchors, n_rows, anchor_block, row_block)
    found = checkpointed(merged(met.mapInArrow(_positives(positives), "anchor_id long, ids array<long>, scores array<long>"), ["anchor_id"], positives), "positives")
    asked = anchors.join(found.select(F.col("anchor_id").alias("vec_id"), F.col("scores").alias("positive_scores")), "vec_id")
    met = in_cells(asked, rows, "vec_id", n_anchors, n_rows, anchor_block, row_block)
    hits = merged(met.mapInArrow(_negatives(negatives, positives, low, high), "anchor_id long, place long, ids array<long>, scores array<long>"), ["anchor_id", "place"], negatives)
    pairs = found.select("anchor_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "positive"))
    each = pairs.join(hits, ["anchor_id", "place"]).select("anchor_id", "positive", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "negative"))
    return each.select("anchor_id", F.col("positive.ids").alias("positive_id"), (F.col("pos") + 1).alias("rank"), F.col("negative.ids").alias("negative_id"), F.col("positive.scores").alias("positive_score"), F.col("negative.scores").alias("negative_score"))
