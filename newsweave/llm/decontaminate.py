"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned over every document.

Words are runs of letters and digits (any non-ASCII character counts as a letter), A-Z lowered.  A window is `width` consecutive words of an
item; an item with fewer words is one window.  The hashes of all word windows of a text are looked up in a bit table, then in
the sorted hashes, and each hit is verified on its words.

The set is broadcast in blocks of at most `block_windows` windows, so the size of a broadcast is bounded whatever the
size of the benchmark; documents pass through one scan per block and gather the hits, without a shuffle.

Defined results: null text or a text without words has no words, no hits and is clean; null benchmark texts and items without words
have no windows; a null item id counts as the empty string; repeated items count once by id; repeated documents are judged each on their own;
columns of the input named like an output column are replaced; empty tables give empty or clean results."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import ASCII_LOWER, LETTERS_DIGITS, hash_words, mix, slices, text_bytes

WIDTH = 13
BLOCK_WINDOWS = 200_000  # windows in one broadcast, some 30 MB
SLICE = 8 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", SPAN), T.StructField("hit_chars", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= _STEP
        out += words[j : j + n]
    return mix(out)


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (item, width, hash, words): the windows of all items; `words` is the window itself, joined by blanks."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType())])

    def windows(batches):
        for batch in slices(batches, SLICE):
            texts = text_bytes(batch.column("text"))
            rows = []
            for item, text, (hashes, starts, ends) in zip(batch.column("item").to_pylist(), texts, hash_words(texts, LETTERS_DIGITS)):
                if not len(hashes):
                    continue
                lowered, w = text.translate(ASCII_LOWER), min(width, len(hashes))
                words = [lowered[a:b] for a, b in zip(starts, ends)]
                rows += [(item or "", w, int(h), b" ".join(words[i : i + w])) for i, h in enumerate(window_hashes(hashes, w).view(np.int64))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))

    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(windows, schema).distinct()


class WindowSet:
    """Hash set of windows by width: a bit table in front of sorted hashes, with the windows for verification."""

    def __init__(self, rows):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[bytes, str]]]]] = {}
        for width in sorted({r.width for r in rows}):
            known: dict[int, list[tuple[bytes, str]]] = {}
            for r in rows:
                if r.width == width:
                    known.setdefault(r.hash & (1 << 64) - 1, []).append((bytes(r.words), r.item))
            hashes = np.array(sorted(known), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[hashes >> np.uint64(44)] = True
            self.by_width[width] = bits, hashes, known

    def hits(self, text: bytes, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items, lowered = [], set(), None
        for width, (bits, hashes, known) in self.by_width.items():
            found = window_hashes(words, width)
            maybe = np.flatnonzero(bits[found >> np.uint64(44)])
            maybe = maybe[np.isin(found[maybe], hashes)] if len(maybe) else maybe
            for i in maybe.tolist():
                lowered = lowered if lowered is not None else text.translate(ASCII_LOWER)
                window = b" ".join(lowered[a:b] for a, b in zip(starts[i : i + width], ends[i : i + width]))
                same = [item for words_of, item in known[int(found[i])] if words_of == window]
                if same:
                    spans.append((i, i + width))
                    items.update(same)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _char_spans(text: bytes, spans: list[tuple[int, int]], starts, ends) -> list[dict]:
    cuts = sorted({int(b) for s, e in spans for b in (starts[s], ends[e - 1])})
    chars, total = {}, 0
    for a, b in pairwise([0, *cuts]):
        total += len(text[a:b].decode())
        chars[b] = total
    return [{"start": chars.get(int(starts[s]), 0), "end": chars[int(ends[e - 1])]} for s, e in spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with `n_words`, `hit_words` (merged word spans inside benchmark windows), `hit_chars` (the same spans in code
    points) and `items` (sorted ids of items with a window in the document)."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, width)
    blocks = max(1, -(-windows.count() // block_windows))
    kept = [c for c in docs.columns if c not in {f.name for f in FOUND}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *FOUND])
    arrow = to_arrow_schema(schema)
    empty = {"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast(SPAN), "hit_chars": F.array().cast(SPAN), "items": F.array().cast("array<string>")}
    out = docs.select(*kept, *(c.alias(n) for n, c in empty.items()))
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block).collect()  # about block_windows rows
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(rows))
        out = out.mapInArrow(_scan(shared, kept, text_col, arrow), schema)
    return out


def _scan(shared, kept: list[str], text_col: str, arrow: pa.Schema):
    def scan(batches):
        known = shared.value
        for batch in slices(batches, SLICE):
            texts = text_bytes(batch.column(text_col).cast(pa.string()))
            before = batch.select(["hit_words", "items"]).to_pylist()
            counts, spans_out, chars_out, items_out = [], [], [], []
            for text, (words, starts, ends), old in zip(texts, hash_words(texts, LETTERS_DIGITS), before):
                spans, items = known.hits(text, words, starts, ends)
                spans = merged(spans + [(s["start"], s["end"]) for s in old["hit_words"]])
                counts.append(len(words))
                spans_out.append([{"start": s, "end": e} for s, e in spans])
                chars_out.append(_char_spans(text, spans, starts, ends))
                items_out.append(sorted(items | set(old["items"])))
            found = [pa.array(x, arrow.field(f.name).type) for f, x in zip(FOUND, (counts, spans_out, chars_out, items_out))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], schema=arrow)

    return scan


def hit_count() -> Column:
    """Number of words inside benchmark windows."""
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated(share: int = 20) -> Column:
    """At least one word in `share` lies inside benchmark windows."""
    return (hit_count() > 0) & (hit_count() * share >= F.col("n_words"))


def _shadowed(docs: DataFrame) -> dict[str, str]:
    """New names for columns named like an output column, so that they come back as they were."""
    return {f.name: f"_own_{f.name}" for f in FOUND if f.name in docs.columns}


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    names = _shadowed(docs)
    found = find_contamination(docs.withColumnsRenamed(names), benchmark, **how).filter(~is_contaminated()).drop(*(f.name for f in FOUND))
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All documents, with the benchmark passages cut out of their texts."""
    names = _shadowed(docs)
    found = find_contamination(docs.withColumnsRenamed(names), benchmark, text_col=text_col, **how)
    gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.col("hit_chars.end")), F.concat(F.col("hit_chars.start"), F.array(F.length(text_col).cast("long"))),
                      lambda a, b: F.substring(F.col(text_col), (a + 1).cast("int"), (b - a).cast("int")))
    clean = found.withColumn(text_col, F.when(F.size("hit_chars") > 0, F.array_join(gaps, "")).otherwise(F.col(text_col))).drop(*(f.name for f in FOUND))
    return clean.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)
