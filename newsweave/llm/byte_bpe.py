"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding: documents are read in chunks of bounded size.  A chunk contributes each of its distinct pre-tokens once, packed by
word bucket; the buckets are shuffled, so that each distinct word of the corpus is encoded in one place, once; its ids go back to the
chunks that asked, where they are joined to the word positions and put together in the order of the text.  No word is hot: a word costs one entry per
chunk, however often it occurs.  What is shuffled is packed and compressed, documents included.

Decoding: the token-byte table (bounded by the vocabulary, a few MB at most) is broadcast and joined to the ids by index.

The chunks of the second reading must be those of the first; this holds for tables read from files.  For other inputs pass
`stored=True`, which writes the documents first.  A difference is found by count and checksum and raises an error.

Defined results: null text counts as empty and has no ids; repeated rows are encoded each on their own; very long texts are split
only where the pattern splits in any case; an empty table gives an empty result; a column of the input named like an output column is replaced."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import give_back, slices
from newsweave.session import checkpointed

CHUNK = 5 << 20  # bytes of documents whose distinct words are gathered together
PIECE = 1 << 20  # characters that the pattern scans at once
KNOWN_WORDS = 500_000  # encoded words a task keeps; past that it starts anew
_SAFE_CUT = re.compile(r"(?<=\S)\s")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces; a cut lies between a character and white space, where two matches always meet."""
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = _SAFE_CUT.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _pack(lengths: list[int], body: bytes) -> bytes:
    return zstandard.compress(np.array([len(lengths)], "<u4").tobytes() + np.array(lengths, "<u4").tobytes() + body, 1)


def _unpack(payload: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), raw[4 + 4 * n :]


def text_chunks(batches: Iterator[pa.RecordBatch], size_of: int = CHUNK) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows of a partition in chunks of bounded size, each with an id.  The cuts depend on the texts alone, not on other
    columns or on the batches."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + size_of - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= size_of:
                yield number, held
                held, size, number = [], 0, number + 1
                give_back()
    if held:
        yield number, held
        del held
        give_back()


def _by_bucket(words, buckets: int) -> list[list[bytes]]:
    """Distinct words (bytes) by bucket, in order."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in sorted(w.encode() for w in words):
        out[zlib.crc32(word) % buckets].append(word)
    return out


def _scanner(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _ask(pattern: str, buckets: int):
    """Chunks -> their distinct words, packed by bucket."""

    def run(batches):
        find = _scanner(pattern)
        for chunk, held in text_chunks(batches):
            words: set[str] = set()
            for batch in held:
                for text in batch.column("text").to_pylist():
                    for piece in _pieces(text or ""):
                        words.update(find(piece))
            rows = [(b, chunk, _pack([len(w) for w in some], b"".join(some))) for b, some in enumerate(_by_bucket(words, buckets)) if some]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "chunk", "payload"])

    return run


def _answer(ranks):
    """Packed words -> packed ids; each distinct word is encoded once."""

    def run(batches):
        import tiktoken

        one = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for payload in batch.column("payload").to_pylist():
                lengths, body = _unpack(payload)
                ids, ends = [], np.cumsum(lengths).tolist()
                for start, end in zip([0, *ends], ends):
                    word = body[start:end]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(one(word), "<u4").tobytes()
                    ids.append(found)
                if len(known) > KNOWN_WORDS:
                    known = {}
                out.append(_pack([len(x) // 4 for x in ids], np.array([zlib.crc32(body)], "<u4").tobytes() + b"".join(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("chunk"), pa.array(out, pa.binary())], names=["bucket", "chunk", "payload"])

    return run


def packed_documents(size_of: int = CHUNK):
    """Chunks -> their rows, as compressed Arrow streams."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for chunk, held in text_chunks(batches, size_of):
            for at, batch in enumerate(slices(held, CHUNK // 8)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "part", "payload"])

    return run


def unpacked_documents(documents: pa.Table) -> list[pa.RecordBatch]:
    """The rows of one chunk, in order."""
    return [pa.ipc.open_stream(p).read_next_batch() for _, p in sorted(zip(documents.column("part").to_pylist(), documents.column("payload").to_pylist()))]


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length]."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


def _reassemble(pattern: str, buckets: int, kept: list[str], out_col: str, arrow: pa.Schema, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
    """A chunk's documents and the ids of its distinct words -> documents with ids, or what `finish` makes of them."""

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        find = _scanner(pattern)
        batches = unpacked_documents(documents)
        index: dict[str, int] = {}
        codes, sizes = [], []  # per batch: places of all words, and the number of words of each document
        for batch in batches:
            found = [np.array([index.setdefault(w, len(index)) for piece in _pieces(text or "") for w in find(piece)], np.int32) for text in batch.column("text").to_pylist()]
            codes.append(np.concatenate([np.zeros(0, np.int32), *found]))
            sizes.append([len(f) for f in found])
        lengths, ids, check = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], {}
        for bucket, payload in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist())):
            some, body = _unpack(payload)
            numbers = np.frombuffer(body, "<u4")
            check[bucket] = int(numbers[0])
            lengths.append(some)
            ids.append(numbers[1:])
        words = _by_bucket(index, buckets)
        if check != {b: zlib.crc32(b"".join(some)) for b, some in enumerate(words) if some}:
            raise RuntimeError("a second reading of the documents gave other rows; pass stored=True")
        order = np.zeros(len(index), np.int64)
        order[[index[w.decode()] for some in words for w in some]] = np.arange(len(index))
        lengths, ids = np.concatenate(lengths).astype(np.int64), np.concatenate(ids)
        starts = np.cumsum(lengths) - lengths
        parts = []
        for batch, words_of, counts in zip(batches, codes, sizes):
            places = order[words_of]
            values = take_runs(ids, starts[places], lengths[places])
            ends = np.concatenate(([0], np.cumsum(lengths[places])))[np.concatenate(([0], np.cumsum(counts)))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))
            encoded = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, out_col])
            parts.append(finish(encoded) if finish else encoded)
        del index, batches, words, ids
        give_back()
        return pa.Table.from_batches(parts).cast(arrow)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out_col: str = "ids", stored: bool = False,
           finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, finish_fields: list[T.StructField] | None = None) -> DataFrame:
    """The documents with `ids` (array of int) in place of the text, as a tokenizer with these ranks and this split pattern would
    encode them without special tokens.  `finish` may turn each batch of encoded documents (ids last) into other columns, `finish_fields`, in the same worker."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    docs = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(kept)), F.col(text_col).cast("string").alias("text"))
    if stored:
        docs = checkpointed(docs, "documents")
    names = docs.columns[:-1]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    new = finish_fields or [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(docs.schema[c] for c in names), *new])
    asked = docs.select("text").mapInArrow(_ask(pattern, buckets), "bucket int, chunk long, payload binary")
    answers = asked.repartition(F.col("bucket")).mapInArrow(_answer(spark.sparkContext.broadcast(ranks)), asked.schema)
    packed = docs.mapInArrow(packed_documents(), "chunk long, part int, payload binary")
    encoded = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_reassemble(pattern, buckets, names, out_col, to_arrow_schema(schema), finish), schema)
    return encoded.select(*(F.col(n).alias(c) for n, c in zip(names, kept)), *(f.name for f in new))


class TokenBytes:
    """Token-byte table: all bytes in one buffer, with starts and lengths by id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return take_runs(self.data, self.starts[ids], self.lengths[ids]).tobytes()


def id_lists(column: pa.ListArray) -> list[np.ndarray]:
    """The ids of each row."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with `decoded`, the bytes of their ids, in place of the ids."""
    table = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks))
    kept = [c for c in encoded.columns if c not in (ids_col, out_col)]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tokens = table.value
        for batch in slices(batches, CHUNK):
            decoded = pa.array([tokens.decode(ids) for ids in id_lists(batch.column(ids_col))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], schema=arrow)

    return encoded.mapInArrow(run, schema)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _digests(table):
    def finish(encoded: pa.RecordBatch) -> pa.RecordBatch:
        ids = id_lists(encoded.column(encoded.num_columns - 1))
        columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                   pa.array([hashlib.sha256(table.value.decode(x)).hexdigest() for x in ids], pa.string())]
        return pa.RecordBatch.from_arrays([*encoded.columns[:-1], *columns], names=[*encoded.schema.names[:-1], *(f.name for f in DIGESTS)])

    return finish


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", stored: bool = False) -> DataFrame:
    """The documents without their text, with `n_tokens`, `ids_sha256` (of the ids as little-endian unsigned 32-bit integers) and `decoded_sha256` (of the
    bytes that the ids decode to).  Ids are decoded where they were put together, so they do not travel."""
    kept = [c for c in docs.columns if c not in (text_col, *(f.name for f in DIGESTS))]
    table = docs.sparkSession.sparkContext.broadcast(TokenBytes(ranks))
    return encode(docs.select(*kept, text_col), ranks, pattern, text_col, stored=stored, finish=_digests(table), finish_fields=DIGESTS)
