"""Exact deduplication by Grace hashing.

Rows are dealt by a fingerprint of their normalised text (the shuffle is the first level of partitioning).  A task
that gets more distinct content than its table may hold writes its records to spill files by the next bits of the
fingerprint, and does so again with each file until a bucket fits an open-addressing table.  The table compares complete
contents, so a clash of fingerprints never merges two texts.

Copies are merged before the shuffle within blocks of rows and again whenever a table fills, so a text that a third of all
rows share costs one record for each block and its bucket never overflows.

Defined results: null text counts as empty text; a null id is lower than any id; among rows that repeat the id of
the row that stays, the last by position in the input stays; an empty table gives an empty result; other columns are
carried along untouched."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import ASCII_LOWER, slices, text_bytes
from newsweave.session import checkpointed

BLOCK_BYTES = 16 << 20  # rows merged at once before the shuffle
TABLE_BYTES = 96 << 20  # content that one table may hold
FANOUT_BITS = 4
KEY, ROW, COUNT = "_fingerprint", "_row", "_copies"


def normalised(text: bytes) -> bytes:
    return text.translate(ASCII_LOWER)


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class ContentTable:
    """Open addressing with linear probing over rows of one table; equal means equal complete contents."""

    def __init__(self, rows: pa.Table, id_col: str, text_col: str):
        self.rows, self.mask = rows, (1 << max(4, (2 * rows.num_rows).bit_length())) - 1
        self.keys = rows.column(KEY).to_pylist()
        self.texts = rows.column(text_col)
        ids = rows.column(id_col).to_pylist()
        self.order = [(i is not None, i if i is not None else 0, r) for i, r in zip(ids, rows.column(ROW).to_pylist())]
        self.counts = rows.column(COUNT).to_pylist()

    def content(self, row: int) -> bytes:
        text = self.texts[row].as_py()
        return normalised((text or "").encode())

    def classes(self) -> tuple[list[int], list[int]]:
        """Best row and number of rows of each class of equal contents."""
        slots = array("q", [-1]) * (self.mask + 1)
        best, total, keys = [], [], self.keys
        for row in range(len(keys)):
            at = int.from_bytes(keys[row][-8:], "little") & self.mask
            while (known := slots[at]) >= 0:
                held = best[known]
                if keys[held] == keys[row] and self.content(held) == self.content(row):
                    total[known] += self.counts[row]
                    if self.order[row] > self.order[held]:
                        best[known] = row
                    break
                at = (at + 1) & self.mask
            else:
                slots[at] = len(best)
                best.append(row)
                total.append(self.counts[row])
        return best, total


def _merge(rows: pa.Table, id_col: str, text_col: str) -> pa.Table:
    best, total = ContentTable(rows, id_col, text_col).classes()
    kept = rows.take(pa.array(best, pa.int64()))
    return kept.set_column(kept.schema.get_field_index(COUNT), pa.field(COUNT, pa.int64()), pa.array(total, pa.int64()))


class GraceBuckets:
    """Yields tables of distinct contents that each fit in memory; no content is in two of them."""

    def __init__(self, id_col: str, text_col: str, table_bytes: int):
        self.id_col, self.text_col, self.table_bytes = id_col, text_col, table_bytes
        self.folder: str | None = None
        self.spilled = 0

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        try:
            yield from self._level(batches, 0)
        finally:
            if self.folder:
                shutil.rmtree(self.folder, ignore_errors=True)

    def _merged(self, held: list[pa.RecordBatch]) -> pa.Table:
        return _merge(pa.Table.from_batches(held).combine_chunks(), self.id_col, self.text_col)

    def _level(self, batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > self.table_bytes:
                merged = self._merged(held)
                held, size = merged.to_batches(), merged.nbytes
                if size > self.table_bytes // 2 and len(set(merged.column(KEY).to_pylist())) > 1 and level < 256 // FANOUT_BITS:
                    yield from self._spill(held, batches, level)
                    return
        if held:
            yield self._merged(held)

    def _spill(self, held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.Table]:
        self.folder = self.folder or tempfile.mkdtemp(prefix="grace-")
        self.spilled += 1
        here = tempfile.mkdtemp(prefix=f"level{level}-", dir=self.folder)
        shift, writers = level * FANOUT_BITS, {}
        for batch in (b for part in (held, rest) for b in part):
            routes: dict[int, list[int]] = {}
            for row, key in enumerate(batch.column(KEY).to_pylist()):
                routes.setdefault(int.from_bytes(key, "big") >> shift & (1 << FANOUT_BITS) - 1, []).append(row)
            for bucket, rows in routes.items():
                if bucket not in writers:
                    writers[bucket] = pa.ipc.new_stream(os.path.join(here, str(bucket)), batch.schema)
                writers[bucket].write_batch(batch.take(pa.array(rows, pa.int64())))
        for writer in writers.values():
            writer.close()
        for bucket in sorted(writers):
            path = os.path.join(here, str(bucket))
            with pa.OSFile(path) as file, pa.ipc.open_stream(file) as reader:
                yield from self._level(iter(reader), level + 1)
            os.remove(path)


def _records(docs: DataFrame, id_col: str, text_col: str, fingerprint: Callable[[bytes], bytes]) -> DataFrame:
    """One row per distinct content of each block of rows: the row with the largest id, its fingerprint, and the number of copies."""
    numbered = docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField(KEY, T.BinaryType()), T.StructField(COUNT, T.LongType())])
    arrow = to_arrow_schema(schema)

    def merge_blocks(batches):
        for batch in slices(batches, BLOCK_BYTES):
            keys = [fingerprint(normalised(x)) for x in text_bytes(batch.column(text_col))]
            rows = pa.Table.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array([1] * len(keys), pa.int64())], names=[*batch.schema.names, KEY, COUNT])
            yield from _merge(rows, id_col, text_col).cast(arrow).to_batches()

    return numbered.mapInArrow(merge_blocks, schema)


def _classes(docs: DataFrame, id_col: str, text_col: str, fingerprint, table_bytes: int, finish: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def buckets(batches):
        for bucket in GraceBuckets(id_col, text_col, table_bytes).run(batches):
            yield from finish(bucket).cast(arrow).to_batches(max_chunksize=5000)

    return _records(docs, id_col, text_col, fingerprint).repartition(F.col(KEY)).mapInArrow(buckets, schema)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[bytes], bytes] = sha256, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts (after lowering A-Z) the row with the largest id."""
    names = docs.columns
    return _classes(docs, id_col, text_col, fingerprint, table_bytes, lambda bucket: bucket.select(names), docs.schema)


def exact_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[bytes], bytes] = sha256, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: its id, `keep_id`, `group_size`, `kept` and the `fingerprint` of its normalised text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")  # read twice: numbers must agree
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("fingerprint", T.BinaryType()), T.StructField("keep_id", id_type), T.StructField("keep_row", T.LongType()),
                           T.StructField("group_size", T.LongType()), T.StructField("clash", T.StringType())])

    def finish(bucket: pa.Table) -> pa.Table:
        keys = bucket.column(KEY).to_pylist()
        seen: dict[bytes, int] = {}
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        clash = [normalised((bucket.column("text")[i].as_py() or "").encode()).decode() if seen[k] > 1 else None for i, k in enumerate(keys)]
        return pa.table([bucket.column(KEY), bucket.column("id"), bucket.column(ROW), bucket.column(COUNT), pa.array(clash, pa.string())], names=schema.names)

    classes = checkpointed(_classes(docs, "id", "text", fingerprint, table_bytes, finish, schema), "grace")
    members_schema = T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("fingerprint", T.BinaryType())])

    def members(batches, with_text=False):
        for batch in slices(batches, BLOCK_BYTES):
            texts = [normalised(x) for x in text_bytes(batch.column("text"))]
            columns = [batch.column("id"), batch.column(ROW), pa.array([fingerprint(x) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in texts], pa.string())] * with_text, names=members_schema.names + ["clash"] * with_text)

    rows = docs
    found = rows.mapInArrow(members, members_schema).join(classes.filter("clash is null"), "fingerprint")
    if not classes.filter("clash is not null").isEmpty():  # different texts under one fingerprint are told apart by content
        with_text = T.StructType([*members_schema.fields, T.StructField("clash", T.StringType())])
        clashes = rows.mapInArrow(lambda batches: members(batches, True), with_text).join(classes.filter("clash is not null"), ["fingerprint", "clash"])
        found = found.select("id", "row", "fingerprint", "keep_id", "keep_row", "group_size").unionByName(clashes.select("id", "row", "fingerprint", "keep_id", "keep_row", "group_size"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "fingerprint")
