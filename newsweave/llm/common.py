"""Shared helpers of the operators in this folder: whole-batch word hashing, slicing and stored tables.

Word hashing works on the bytes of many texts at once: `sum(T[byte] * R**position)` modulo 2**64 is a running sum, so
the hash of any word is a difference of two of its values, brought to position 0.  T is a table of random odd
numbers and the result is mixed, so the hash of a word does not depend on where the word stands."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 17  # texts are hashed in slices of about this many bytes; a longer text is cut between words
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_trim = None

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes that is true inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= SLICE_BYTES + 1:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (a bijection on 64-bit integers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(data: np.ndarray, word: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_RADIX, len(data)), dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])
    return hashes, starts, ends


def hash_words(texts: list[bytes], word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (bytes, A-Z lowered here): the 64-bit hashes of its words in order, and their start and end bytes.
    `word` is the byte class of word characters."""
    i = 0
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_BYTES):
            size += len(texts[j])
            j += 1
        if size == 0:
            yield from [none] * (j - i)
        elif size > SLICE_BYTES:
            yield _long_text(texts[i], word)
        else:
            data = np.frombuffer(b"".join(texts[i:j]).translate(ASCII_LOWER), np.uint8)
            offsets = np.cumsum([0, *map(len, texts[i:j])])
            hashes, starts, ends = _hash_block(data, word, offsets[:-1][offsets[:-1] < len(data)])
            cuts = np.searchsorted(starts, offsets)
            for k in range(j - i):
                a, b = cuts[k], cuts[k + 1]
                yield hashes[a:b], starts[a:b] - offsets[k], ends[a:b] - offsets[k]
        i = j


def _long_text(text: bytes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at, out = text.translate(ASCII_LOWER), 0, []
    data = np.frombuffer(parts, np.uint8)
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a slice: go on to its end
                rest = np.flatnonzero(~word[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        hashes, starts, ends = _hash_block(data[at:end], word, np.zeros(1, np.int64))
        out.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system, which a worker that is kept for later tasks would hold on to otherwise."""
    global _trim
    pa.default_memory_pool().release_unused()
    if _trim is None:
        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # not every C library has it
            _trim = lambda _: 0
    _trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `max_bytes` (a longer row stands alone)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
        del batch
        give_back()


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(column: str):
    """The same in SQL functions."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
