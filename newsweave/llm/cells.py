"""Helpers of searches that hold a stated query set against all rows: cells of a block matrix join and bounded best lists.

Queries are dealt to blocks and rows to slots by hash; every (block, slot) pair is a cell, and a cell lies in one task, where its queries
come first and its rows stream past them.  So a task holds one block of queries, one batch of rows and one best list a query, whatever
the number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TASKS = 50_000  # of one join; beyond that a task takes several cells, one after the other
LAST_ID = np.iinfo(np.int64).max  # stands in an empty place of a list


def is_usable(vector: str) -> Column:
    """Neither null nor empty, and all components are finite numbers."""
    v, least = F.col(vector), F.lit(float("inf")).cast("double")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < least)), F.lit(False))


def in_cells(queries: DataFrame, rows: DataFrame, key: str, n_queries: int, n_rows: int, query_block: int, row_block: int) -> DataFrame:
    """Both sides (tables of the same columns) repeated for their cells: adds `cell` and `kind` (0: query, 1: row); a cell is one run of the sorted partition, its queries first."""
    blocks, slots = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // row_block))
    block, slot = F.pmod(F.xxhash64(key), F.lit(blocks)), F.pmod(F.xxhash64(key), F.lit(slots))
    all_slots, all_blocks = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.withColumn("_other", all_slots).select((block * slots + F.col("_other")).alias("cell"), F.lit(0).alias("kind"), *queries.columns)
    met = rows.withColumn("_other", all_blocks).select((F.col("_other") * slots + slot).alias("cell"), F.lit(1).alias("kind"), *rows.columns)
    tasks = min(blocks * slots, MOST_TASKS)
    return asked.unionByName(met, allowMissingColumns=True).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "kind")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, pa.RecordBatch]]]:
    """For each cell of a partition the (kind, part of a batch) in order."""

    def parts():
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            yield from ((cell[a], (kind[a], batch.slice(a, b - a))) for a, b in zip(edges, edges[1:]))

    for _, of_cell in groupby(parts(), key=lambda x: x[0]):
        yield (part for _, part in of_cell)


def by_length(column: pa.Array, dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, values[offsets[at][:, None] + np.arange(n)].astype(dtype)


class BestLists:
    """The k best (score, id) of each of n queries: higher scores first, ties by smaller id.  With `others`, each entry carries one more number along."""

    def __init__(self, n: int, k: int, dtype, others: bool = False):
        self.lowest = -np.inf if np.issubdtype(dtype, np.floating) else np.iinfo(dtype).min + 1
        self.scores, self.ids = np.full((n, k), self.lowest, dtype), np.full((n, k), LAST_ID, np.int64)
        self.others = np.zeros((n, k), np.int64) if others else None

    @property
    def floor(self) -> np.ndarray:
        """Scores that a candidate must reach; the lowest number while a list has room."""
        return self.scores[:, -1]

    def offer(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, others: np.ndarray | None = None) -> None:
        k = self.scores.shape[1]
        touched, own = np.unique(query, return_inverse=True)
        query = np.concatenate([np.repeat(np.arange(len(touched)), k), own])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, query))
        first = order[np.searchsorted(query[order], np.arange(len(touched)))[:, None] + np.arange(k)]
        self.scores[touched], self.ids[touched] = scores[first], ids[first]
        if others is not None:
            self.others[touched] = np.concatenate([self.others[touched].ravel(), others])[first]

    def lists(self) -> tuple[list[np.ndarray], ...]:
        """Ids and scores (and others) of each query without empty places."""
        full = self.scores > self.lowest
        return tuple([row[f] for row, f in zip(x, full)] for x in (self.ids, self.scores, self.others) if x is not None)


def kth_largest(bounds: np.ndarray, k: int, lowest: float) -> np.ndarray:
    """For each row of a matrix its k-th largest value; `lowest` where it has fewer."""
    n = bounds.shape[1]
    return np.partition(bounds, n - k, axis=1)[:, n - k] if n >= k else np.full(len(bounds), lowest, bounds.dtype)


def merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One list per key (long columns) out of the lists (`ids`, `scores`, best first, and `others` if there are any) of its cells.  A task streams through its
    sorted keys and merges the lists of one key by a heap, so many at a time, whatever their number."""
    at_once = 256
    columns = [c for c in ("ids", "scores", "others") if c in lists.columns]
    schema = lists.select(*keys, *columns).schema
    kinds = [*[pa.int64()] * len(keys), *[pa.list_(pa.float64() if "double" in schema[c].dataType.simpleString() else pa.int64()) for c in columns]]

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in columns)))

        def best_of(group):
            best: list[tuple] = []
            while some := [[(-s, i, *rest) for i, s, *rest in zip(*entries)] for _, entries in islice(group, at_once)]:
                best = list(islice(merge(best, *some), k))
            return [[e[1] for e in best], [-e[0] for e in best], *([e[j] for e in best] for j in range(2, len(columns)))]

        found = ((*of, *best_of(group)) for of, group in groupby(rows(), key=lambda x: x[0]))
        while some := list(islice(found, 2_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds)], names=schema.names)

    return lists.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
