"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A document's set holds its distinct runs of five words (A-Z lowered; all words as one if there are fewer).  Its signature has 32 components of
16 bits; the distance of two signatures is the number of components that differ.  The signature is split into 8 chunks of 4; of two
signatures at a distance of 15 or less some chunk has one difference at most (pigeonhole), so with each component of
each chunk left out in turn (32 keys) they share a key.  At a similarity of exactly 0.85 the chance that no chunk has less than two
differences is 0.11**8, about 2e-8.

No step makes all pairs of a group:

1. equal sets become one class (aggregated before the shuffle), and one row per class goes on;
2. within the bucket of a key, a 128-byte sketch drops pairs that are far below the threshold (5.5 standard deviations), and a bucket emits a spanning forest of the pairs that
   remain, at most one edge per member; connected components of these edges are the candidate groups, so every link lies within one group;
3. the full sets of a group meet in one place; exact intersections are counted there by matrix products, and a forest of the confirmed links is emitted;
4. the components of the confirmed links are the answer.

Buckets and groups larger than a block are split into blocks that meet pair by pair, so no task holds an unbounded group.

Defined results: null text, empty text and text without words have the empty set and link with nothing; rows of equal text link with each
other; a null id is larger than any id; of repeated ids the first row is the kept one; texts of any length are taken
whole; an empty table gives an empty result; other columns play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import NOT_SPACE, hash_words, mix, slices, text_bytes
from newsweave.llm.components import connected_components
from newsweave.llm.decontaminate import window_hashes
from newsweave.session import checkpointed

SHINGLE = 5
COMPONENTS, CHUNK, SKETCH = 32, 4, 128
BLOCK = 512  # members of a bucket or group that one task compares with as many others
BLOCK_SHINGLES = 1 << 18
SLICE = 2 << 20
_RNG = np.random.default_rng(5_2024)
_FACTORS = (_RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_LANE = 1 << 12  # shingles hashed at once

Compare = Callable[[list, np.ndarray, np.ndarray], np.ndarray]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words together if there are fewer."""
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else words


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of the hash functions over a set."""
    out = None
    for at in range(0, len(hashes), _LANE):
        low = (hashes[None, at : at + _LANE] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def _signatures(size: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            counts, digests, signatures, sketches = [], [], [], []
            for words, _, _ in hash_words(text_bytes(batch.column("text")), NOT_SPACE):
                found = shingles(words, size)
                counts.append(len(found))
                if not len(found):
                    digests.append(None), signatures.append(None), sketches.append(None)
                    continue
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                low = mix(minima(found))
                signatures.append((low[:COMPONENTS] >> np.uint64(48)).astype("<u2").tobytes())
                sketches.append((low & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, signatures, sketches))],
                                             names=["row", "id", "n_shingles", "set", "signature", "sketch"])

    return run


def _keys(batches):
    """Signatures -> one key per chunk and left-out component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, COMPONENTS).astype(np.uint64)
        keys = []
        for chunk in range(0, COMPONENTS, CHUNK):
            for out in range(CHUNK):
                key = np.full(len(parts), chunk * CHUNK + out + 1, np.uint64)
                for c in range(chunk, chunk + CHUNK):
                    if c != chunk + out:
                        key = key * np.uint64(0xD6E8FEB86659FD93) + parts[:, c]
                        key ^= key >> np.uint64(32)
                keys.append(mix(key))
        rows = np.tile(batch.column("row").to_numpy(), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(rows)], names=["key", "row"])


def in_blocks(members: DataFrame, group: str, blocks: str, row: str) -> DataFrame:
    """Repeat the members of large groups so that each pair of blocks meets: adds i, j (the blocks that meet) and `side`."""
    own = F.pmod(F.xxhash64(row), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return members.withColumn("_own", own).withColumn("_other", other).withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).withColumn("side", F.col("_own") == F.col("j")).drop("_own", "_other", blocks)


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            queue += new.tolist()
            yield from ((at, int(n)) for n in new)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _links(group: str, value: str, compare: Callable[[list[bytes]], np.ndarray]):
    """Sorted members -> forests of the linked pairs of each pair of blocks."""

    def run(batches):
        out_a, out_b = [], []
        for members in _grouped(batches, [group, "i", "j"]):
            n = members.num_rows
            if n < 2:
                continue
            rows = members.column("row").to_pylist()
            linked = compare(members.column(value).to_pylist())
            if members.column("i")[0].as_py() != members.column("j")[0].as_py():  # inside a block the block compares with itself elsewhere
                side = np.array(members.column("side").to_pylist())
                linked &= side[:, None] != side[None, :]
            for a, b in _forest(linked):
                out_a.append(rows[a])
                out_b.append(rows[b])
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def least_matches(similarity: float, deviations: float = 5.5) -> int:
    """Equal sketch bytes that a pair at this similarity has at least, but for this many standard deviations."""
    return int(SKETCH * similarity - deviations * (SKETCH * similarity * (1 - similarity)) ** 0.5)


def _sketches_agree(similarity: float):
    least = least_matches(similarity)

    def compare(sketches: list[bytes]) -> np.ndarray:
        s = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), SKETCH)
        if len(s) <= 24:
            return (s[:, None, :] == s[None, :, :]).sum(axis=2) >= least
        return np.stack([(s == row).sum(axis=1) >= least for row in s])

    return compare


def _sets_agree(percent: int):
    def compare(sets: list[bytes]) -> np.ndarray:
        sizes = np.array([len(s) // 8 for s in sets])
        values, inverse = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(inverse) > 1  # a shingle of one set meets nothing
        column = np.cumsum(shared) - 1
        use = shared[inverse]
        owner, place = owner[use], column[inverse[use]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(place, (at, at + width))
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], place[a:b] - at] = 1
            both += part @ part.T
        np.fill_diagonal(both, sizes)
        both = both.astype(np.int64)
        return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)

    return compare


def _sets(size: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            found = [shingles(words, size).tobytes() for words, _, _ in hash_words(text_bytes(batch.column("text")), NOT_SPACE)]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("row"), batch.column("blocks"), pa.array(found, pa.binary())], names=["component", "row", "blocks", "members"])

    return run


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = SHINGLE, block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row per input row: `row` (its number, taken from `row_col` of a stored table if given), the id, `n_shingles`, `component_id` (smallest id reachable by links, its own included) and `kept`
    (one row of each component).  Two documents are linked if 100 * intersection >= percent * union."""
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not row_col:  # numbers are given once: a second reading may deal files to partitions in another order
        rows = checkpointed(rows, "rows")
    id_type = rows.schema["id"].dataType.simpleString()
    signed = checkpointed(rows.mapInArrow(_signatures(size), f"row long, id {id_type}, n_shingles long, set binary, signature binary, sketch binary"), "signatures")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))
    classes = checkpointed(signed.filter("set is not null").groupBy("set").agg(F.min("row").alias("row"), first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "classes")

    keys = classes.select("row", "signature").mapInArrow(_keys, "key long, row long")
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keys.join(crowded, "key").withColumn("blocks", F.ceil(F.col("n") / block)).drop("n").join(classes.select("row", "sketch"), "row")
    met = in_blocks(members, "key", "blocks", "row").repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    candidates = met.mapInArrow(_links("key", "sketch", _sketches_agree(percent / 100)), "a long, b long")
    groups = connected_components(candidates).withColumnRenamed("vertex", "row")

    weights = groups.join(classes.select("row", "n_shingles"), "row").groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    grouped = groups.join(weights, "component").hint("shuffle_hash")  # the texts stream past the rows that are wanted, unsorted
    wanted = rows.select("row", "text").join(grouped, "row")
    sets = wanted.mapInArrow(_sets(size), "component long, row long, blocks long, members binary")
    met = in_blocks(sets, "component", "blocks", "row").repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j")
    links = met.mapInArrow(_links("component", "members", _sets_agree(percent)), "a long, b long")
    found = connected_components(links).withColumnRenamed("vertex", "row")

    placed = checkpointed(classes.select("set", "row", "first").join(found, "row", "left").select("set", "first", F.coalesce("component", "row").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    answer = placed.join(least, "component").select("set", F.col("least.id").alias("component_id"), F.col("least.row").alias("kept_row"))
    lone = F.col("set").isNull()
    return signed.select("row", "id", "n_shingles", "set").join(answer, "set", "left").select(
        "row", F.col("id").alias(id_col), "n_shingles", F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (lone | (F.col("row") == F.col("kept_row"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one with the smallest id."""
    name = "_row"
    numbered = checkpointed(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    kept = near_duplicate_components(numbered, id_col, text_col, row_col=name, **how).filter("kept").select(F.col("row").alias(name))
    return numbered.join(kept.hint("shuffle_hash"), name, "left_semi").select(docs.columns)
