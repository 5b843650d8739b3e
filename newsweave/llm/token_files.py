"""Token ids in Arrow stream files of fixed-size lists.

Documents are ordered by id over range partitions; each partition writes one shard.  A shard is an Arrow stream file whose batches hold
`sequences` lists of exactly `length` ids and the masks of the same shape; the ids of its documents follow each other without gaps, and only the end of the
last list is padding (mask false).  As batches and lists have fixed sizes and nothing is compressed, a reader maps the file and addresses any sequence,
mask or span of ids without copying.  Beside it lies a stream file with the id and number of tokens of each document.

A task writes under a name of its own and reports it on success, so repeated or speculative attempts never mix;
files of failed attempts are named by no manifest and are deleted at the end.

Encoding: a tokenizer that splits on white space and drops it gives the same ids word by word, so each distinct word
is encoded once by the library's model and kept (bounded).  For any other tokenizer whole texts are encoded.

Defined results: null text counts as empty and gets the end id alone; rows of one id follow each other by a hash of their text; null ids come first;
texts of any length are streamed through buffers of one batch; an empty table gives no shards."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.llm.byte_bpe import take_runs
from newsweave.llm.common import slices
from newsweave.session import checkpointed, scratch_path

LENGTH = 2048  # ids in a sequence
SEQUENCES = 64  # sequences in a batch
SLICE = 4 << 20
KNOWN_WORDS = 1_000_000  # encoded words a worker keeps, some 200 MB
KNOWN_PIECES = 50_000
WORDS_AT_ONCE = 200_000
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the rule that the pieces above agree with
_VISIBLE = re.compile(r"[!-~]+")
_SPACES = re.compile(r"[ \n\r\t]+")
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
MANIFEST = "shard int, path string, index_path string, n_docs long, n_tokens long"


def _byte_characters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, others in order from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Index(dict):
    """Places of known words; an unknown one is learned when asked for."""

    __slots__ = ("learn",)

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        at = self[word] = self.learn(word)
        return at


class WordEncoder:
    """Ids of texts by a tokenizer, word by word where that gives the same ids."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        rule = json.loads(definition)
        steps = (rule.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [n["type"] for n in (rule.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT_RULE} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
                        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and norms == ["NFC", "Replace", "Lowercase"]
                        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or _SPACES.search(t["content"]) for t in rule["added_tokens"]))
        self.added = re.compile("|".join(re.escape(t["content"]) for t in rule["added_tokens"]) or r"(?!)")
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.characters = _byte_characters()
        self._forget()

    def _forget(self) -> None:
        self.index = _Index(self._learn)
        self.known: dict[str, list[int]] = {}
        self.values, self.ends = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64)  # ids of known words; ends[i + 1] is the end of word i
        self.size = self.words = 0
        self.new_ids: list[int] = []
        self.new_ends: list[int] = []

    def _piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else "".join(map(self.characters.__getitem__, piece.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def _known_piece(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > KNOWN_PIECES:
                self.known = {}
            found = self.known[piece] = self._piece(piece)
        return found

    def _word(self, word: str) -> list[int]:
        core = word.rstrip(_PUNCTUATION)
        if core.isalpha():  # letters, perhaps with signs behind them
            plain = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core)
            if plain.isalpha() and not (len(core) < len(word) and self.added.search(word)):
                return self._piece(plain) + self._known_piece(word[len(core):]) if len(core) < len(word) else self._piece(plain)
        elif not word:
            return []
        elif _VISIBLE.fullmatch(word) and not self.added.search(word):
            return [i for piece in _ASCII_PIECES.findall(word.lower()) for i in self._known_piece(piece)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, word: str) -> int:
        self.new_ids += self._word(word)
        self.new_ends.append(self.size + len(self.new_ids))
        return self.words + len(self.new_ends) - 1

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, in parts."""
        if not self.by_word:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
            return
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        for at in range(0, len(words), WORDS_AT_ONCE):
            if len(self.index) > KNOWN_WORDS:
                self._forget()
            some = words[at : at + WORDS_AT_ONCE] if len(words) > WORDS_AT_ONCE else words
            yield self._gather(np.fromiter(map(self.index.__getitem__, some), np.int64, len(some)))

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        if self.new_ends:
            size, words = self.size + len(self.new_ids), self.words + len(self.new_ends)
            if size > len(self.values):
                self.values = np.concatenate((self.values, np.zeros(size, self.dtype)))
            if words + 1 > len(self.ends):
                self.ends = np.concatenate((self.ends, np.zeros(words + 1, np.int64)))
            self.values[self.size : size] = self.new_ids
            self.ends[self.words + 1 : words + 1] = self.new_ends
            self.size, self.words, self.new_ids, self.new_ends = size, words, [], []
        starts = self.ends[codes]
        return take_runs(self.values, starts, self.ends[codes + 1] - starts)


_encoders: dict[int, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def sequence_schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes a stream of ids as batches of fixed-size lists."""

    def __init__(self, sink, dtype, length: int, sequences: int):
        self.schema, self.length, self.room = sequence_schema(dtype, length), length, length * sequences
        self.stream, self.writer, self.dtype = sink, pa.ipc.new_stream(sink, self.schema), dtype
        self.held, self.size, self.total = [], 0, 0

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype, copy=False))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.room:
            self._flush(self.size - self.size % self.room)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for at in range(0, n, self.room):
            self._batch(ids[at : at + self.room])
        self.held, self.size = [ids[n:]], len(ids) - n

    def _batch(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self.length
        mask = np.concatenate((np.ones(len(ids), bool), np.zeros(padding, bool)))
        ids = np.concatenate((ids, np.zeros(padding, self.dtype))) if padding else ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._flush(self.size)
        self.writer.close()
        self.stream.close()


class SequenceFile:
    """Random access to the sequences, masks and id spans of a shard; nothing is copied from a mapped file but spans over several batches."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as reader:
            self.batches = list(reader)
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 0
        self.per_batch = self.batches[0].num_rows if self.batches else 0
        self.ids = [b.column("input_ids").values.to_numpy() for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        batch, row = divmod(i, self.per_batch)
        return self.ids[batch][row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        batch, row = divmod(i, self.per_batch)
        return self.batches[batch].column("mask").values.slice(row * self.length, self.length)

    def span(self, start: int, end: int) -> np.ndarray:
        room, parts = self.length * self.per_batch, []
        while start < end:
            batch, at = divmod(start, room)
            parts.append(self.ids[batch][at : at + end - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def write_token_files(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                      length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """Encode and write all documents in ascending order of their ids, `end_id` after each.  Returns the manifest, one row per shard in order: shard, path,
    index_path, n_docs, n_tokens.  `definition` is the tokenizer's JSON; `folder` must be reachable from all executors (by default one in the shared folder)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(definition)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)

    def write(batches):
        batches = slices(batches, SLICE)
        first = next(batches, None)
        if first is None:
            return
        encoder, shard = _encoder(shared.value), TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        writer = SequenceWriter(fs.open_output_stream(f"{base}/{name}.arrow"), encoder.dtype, length, sequences)
        index_schema = pa.schema([("id", first.schema.field("id").type), ("n_tokens", pa.int64())])
        n_docs = 0
        with fs.open_output_stream(f"{base}/{name}.docs.arrow") as sink, pa.ipc.new_stream(sink, index_schema) as index:
            for batch in (b for part in ([first], batches) for b in part):
                counts = []
                for text in batch.column("text").to_pylist():
                    before = writer.total
                    for ids in encoder.encode(text):
                        writer.write(ids)
                    writer.write(np.array([end_id], encoder.dtype))
                    counts.append(writer.total - before)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], schema=index_schema))
                n_docs += len(counts)
        writer.close()
        path = folder.rstrip("/") + "/" + name
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}.arrow", "index_path": f"{path}.docs.arrow", "n_docs": n_docs, "n_tokens": writer.total}],
                                         schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = checkpointed(rows.mapInArrow(write, MANIFEST), "manifest")
    _drop_orphans(folder, manifest)
    return manifest.withColumn("id_type", F.lit(id_type.simpleString()))


def _drop_orphans(folder: str, manifest: DataFrame) -> None:
    """Delete what failed attempts left: files that the manifest (one row per shard) does not name."""
    named = {p.rsplit("/", 1)[-1] for r in manifest.select("path", "index_path").collect() for p in r}
    fs, base = file_system(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(base)):
            if info.base_name.startswith("shard-") and info.base_name not in named:
                fs.delete_file(info.path)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: `id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32` (of its ids as little-endian unsigned 32-bit
    integers)."""
    spark = manifest.sparkSession
    shards = manifest.orderBy("shard").collect()  # one row per shard
    id_type = shards[0].id_type if shards else "bigint"
    base, rows = 0, []
    for s in shards:
        rows.append((s.shard, s.path, s.index_path, base))
        base += s.n_tokens
    schema = T.StructType([T.StructField("id", T._parse_datatype_string(id_type)), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file, at = SequenceFile(row["path"]), 0
                fs, path = file_system(row["index_path"])
                with fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as index:
                    for docs in index:
                        counts, starts, crcs = docs.column("n_tokens").to_pylist(), [], []
                        for n in counts:
                            starts.append(row["base"] + at)
                            crcs.append(zlib.crc32(file.span(at, at + n).astype("<u4").tobytes()))
                            at += n
                        yield pa.RecordBatch.from_arrays([docs.column("id"), pa.array(starts, pa.int64()), docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=schema.names)

    listed = spark.createDataFrame(rows, "shard int, path string, index_path string, base long")
    return listed.repartitionByRange(max(1, len(rows)), "shard").mapInArrow(read, schema)
