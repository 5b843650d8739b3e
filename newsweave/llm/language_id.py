"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point.  A three-letter sequence is the product of its letters'
vectors, permuted (rotated) by their place; a text is the bundle (sum) of its sequences, words being separated by one blank.  The
prototype of a language is the sum of the unit vectors of its training texts, and a text gets the language whose prototype has
the largest cosine with it.

The prototypes are one vector per language and partition, added up in Spark; only languages x dimensions numbers reach
the driver and the tasks, whatever the size of the corpus (the language labels are a closed set).

Defined results: null text and a text without letters give `und` with score 0, and so does every text if nothing was learned; rows
without a label are not learned from; ties go to the first language in order; columns of the input named like an output column are
replaced; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import slices

DIMENSIONS = 1024
SLICE = 2 << 20  # bytes of text
ROWS = 256  # texts in one matrix product
PIECE = 1 << 20  # characters of a longer text are taken in pieces
TYPES = 2048  # sequences in one block of a matrix product
UNKNOWN = "und"

_letter: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    known = _vectors.get(code)
    if known is None or len(known) != dimensions:
        known = _vectors[code] = np.random.default_rng([code, 7]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return known


def _sequences(text: str) -> np.ndarray:
    """Keys of the three-letter sequences of a text: letters lowered, any other run of characters one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    return codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]


def _bound(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of sequences: letter vectors rotated by place and multiplied."""
    out = None
    for place, shift in ((2, 42), (1, 21), (0, 0)):
        codes, inverse = np.unique(keys >> np.uint64(shift) & np.uint64(0x1FFFFF), return_inverse=True)
        letters = np.stack([np.roll(_letter_vector(int(c), dimensions), place) for c in codes])[inverse]
        out = letters if out is None else out * letters
    return out


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundled vectors of texts, one row each; zero without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    keys, owner = [], []
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), PIECE):
            piece = _sequences(text[at : at + PIECE])
            keys.append(piece)
            owner.append(np.full(len(piece), row))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    if not len(keys):
        return out
    types, inverse = np.unique(keys, return_inverse=True)
    for at in range(0, len(types), TYPES):
        inside = (inverse >= at) & (inverse < at + TYPES) if len(types) > TYPES else slice(None)
        width = min(TYPES, len(types) - at)
        counts = np.bincount(owner[inside] * width + inverse[inside] - at, minlength=len(texts) * width).reshape(len(texts), width)
        out += counts.astype(np.float32) @ _bound(types[at : at + TYPES], dimensions).astype(np.float32)
    return out


def _blocks(batches):
    for batch in slices(batches, SLICE):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language prototypes (unit vectors) from all labelled rows."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in _blocks(batches):
            vectors = _unit(text_vectors(batch.column("text").to_pylist(), dimensions))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}, schema=to_arrow_schema(schema))

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    summed = labelled.mapInArrow(bundle, schema).select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x dimensions rows
        profiles.setdefault(row.lang, np.zeros(dimensions))[row.pos] = row.value
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(profiles.items()) if v.any()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents with `lang_pred` and `score`, the cosine of the text with the chosen prototype (0 at least)."""
    out_fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [c for c in docs.columns if c not in {f.name for f in out_fields}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *out_fields])
    arrow = to_arrow_schema(schema)
    names = list(profiles)
    matrix = np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)

    def predict(batches):
        for batch in _blocks(batches):
            vectors = text_vectors(batch.column(text_col).cast(pa.string()).to_pylist(), dimensions)
            known = vectors.any(axis=1)
            if names:
                cosines = _unit(vectors) @ matrix.T
                best = cosines.argmax(axis=1)
                score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float)
                langs = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            else:
                score, langs = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(score)], schema=arrow)

    return docs.mapInArrow(predict, schema)


def is_accepted(min_score: float) -> Column:
    """A language was found, with at least this cosine."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
