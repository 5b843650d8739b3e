"""Nearest neighbours by inner product, exact: a block matrix join on int8 codes with error bounds, and floats for the pairs that survive.

Each vector x has a scale (its largest component / 127), int8 codes c, and the length e of its error x - scale * c.  The product of two code
matrices, times the scales, differs from the inner product of q and x by at most |q| e_x + e_q (|x| + e_x), so each pair has an upper and a lower
bound.  A pair goes on if its upper bound reaches the larger of two floors: the k-th best score that the query has so far, and the k-th
largest lower bound of the tile.  Pairs that go on are computed in double precision from the original vectors, component by
component from the first to the last, and kept in best lists; the lists of a query's cells are merged by heaps.

The code product runs as a float matrix product, exact for whole numbers: 127 * 127 * 1,024 < 2**24 (longer vectors go in parts).

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without an id; rows that repeat an
id count once, with the smallest of their vectors; vectors of different lengths are not compared; of equal scores the smaller ids come first;
copies of one vector beyond its k + 1 smallest ids can be in no list and are left out before the join; queries with no candidate have
no rows; an empty table gives an empty result; other columns play no part."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.cells import BestLists, by_length, cells, in_cells, is_usable, kth_largest, merged
from newsweave.session import checkpointed

QUERY_BLOCK = 1_024
ROW_BLOCK = 16_384  # rows of a cell
TILE = 1_024  # rows of a tile
EXACT_PART = 1_024
PAIRS = 1 << 16  # pairs that are computed in doubles at a time
ROUNDING = 1e-9  # for the roundings of the bounds themselves, as a share of |q||x|


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers from -127 to 127 held as floats, for the matrix product), scales, lengths of the errors, and lengths of the vectors."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None])
    return codes.astype(np.float32), scale, np.linalg.norm(vectors - codes * scale[:, None], axis=1), np.linalg.norm(vectors, axis=1)


def bounds(q: tuple, x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two quantised blocks."""
    product = np.zeros((len(q[0]), len(x[0])))
    for at in range(0, q[0].shape[1], EXACT_PART):
        product += q[0][:, at : at + EXACT_PART] @ x[0][:, at : at + EXACT_PART].T
    product *= q[1][:, None]
    product *= x[1]
    reach = np.outer(q[3], x[2] + ROUNDING * x[3])
    reach += np.outer(q[2], x[3] + x[2])
    return product - reach, product + reach


def inner_products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The products of the given pairs, summed from the first component to the last."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS):
        a, b, part = rows[at : at + PAIRS], columns[at : at + PAIRS], out[at : at + PAIRS]
        for left, right in zip(q.T, x.T):
            part += left[a] * right[b]
    return out


def _search(k: int):
    def run(batches):
        for cell in cells(batches):
            asked, first = [], None
            for kind, part in cell:
                if kind:
                    first = part
                    break
                asked.append(part)
            if not asked or first is None:
                continue
            table = pa.Table.from_batches(asked)
            best = BestLists(table.num_rows, k, np.float64)
            queries = {n: (at, v, quantise(v)) for n, at, v in by_length(table.column("embedding"), np.float64)}
            for part in chain([first], (part for _, part in cell)):
                ids = part.column("vec_id").to_numpy()
                for n, at, vectors in by_length(part.column("embedding"), np.float64):
                    if n in queries:
                        for a in range(0, len(at), TILE):
                            _tile(best, *queries[n], vectors[a : a + TILE], ids[at[a : a + TILE]])
            found, scores = best.lists()
            yield pa.RecordBatch.from_pydict({"query_id": table.column("vec_id").combine_chunks(), "ids": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    return run


def _tile(best: BestLists, own: np.ndarray, q: np.ndarray, codes: tuple, x: np.ndarray, ids: np.ndarray) -> None:
    low, high = bounds(codes, quantise(x))
    floor = best.floor[own]
    if np.isinf(floor).any():
        floor = np.maximum(floor, kth_largest(low, best.scores.shape[1], -np.inf))
    rows, columns = np.nonzero(high >= floor[:, None])
    if len(rows):
        best.offer(own[rows], inner_products(q, x, rows, columns), ids[columns])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows with the largest inner product for each row that `is_query` (a condition on `vec_id`) selects, itself excluded: query_id, rank (from 1), vec_id, score."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    usable = given.filter(F.col("vec_id").isNotNull() & is_usable("embedding")).filter(F.exists("embedding", lambda x: x != 0))
    kept = checkpointed(usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("same", F.xxhash64("embedding")), "vectors")
    copies = Window.partitionBy("same", "embedding").orderBy("vec_id")
    rows = kept.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "embedding")
    queries = kept.filter(is_query).select("vec_id", "embedding")
    met = in_cells(queries, rows, "vec_id", queries.count(), kept.count(), query_block, row_block)
    lists = merged(met.mapInArrow(_search(k + 1), "query_id long, ids array<long>, scores array<double>"), ["query_id"], k + 1)
    others = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, k)
    return lists.select("query_id", F.posexplode(others).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
