"""Licences of files: sparse TF-IDF cosine of their passages to licence templates, then inheritance from the nearest ancestor directory.

Document frequencies are counted over all files, for the words of the templates (a bounded vocabulary); a word outside it weighs as much as the
rarest.  Passages are the lines, the paragraphs of several lines and the whole text of a file, so headers, notices inside a text and licence
files are covered alike.  A passage whose known part is too small to reach the threshold with any template is skipped by an exact bound; for the
others the cosine with every template is taken.  The whole text of a file is also held against whole licence texts, with a vocabulary of their own; one
that it reaches outranks all notices, as these texts name other licences too.

A licence file gives its licence to its directory.  A file without a licence of its own takes the one of the nearest directory above it that has one:
distinct directories are joined to their ancestors by path, and files to directories.

Defined results: null text or path counts as empty; a file without any licence has null; ties go to the first template in order, then to the earlier passage; of several
licence files in a directory the best match counts, then the first licence in order; repeated rows are scanned each on their own; an empty table
gives an empty result; columns of the input named like an output column are replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import LETTERS_DIGITS, hash_words, slices, text_bytes
from newsweave.llm.license_texts import TEXTS
from newsweave.session import checkpointed

SLICE = 4 << 20
THRESHOLD = 0.6
WHOLE_THRESHOLD = 0.75  # a licence text without a template must not go to a distant relative
FOUND = [T.StructField("license", T.StringType()), T.StructField("license_score", T.DoubleType()), T.StructField("license_from", T.StringType())]

# Short notices by which licences are named in files.
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
]


class Templates:
    """Unit TF-IDF vectors of the templates over their own vocabulary of word hashes."""

    def __init__(self, notices: list[tuple[str, str]]):
        self.names = [name for name, _ in notices]
        words = [h for h, _, _ in hash_words([text.encode() for _, text in notices], LETTERS_DIGITS)]
        self.vocabulary = np.unique(np.concatenate(words))
        self.counts = np.stack([np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in words]).astype(float)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Index of each word in the vocabulary, its size for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def weigh(self, frequencies: dict[int, int], files: int) -> None:
        """Inverse document frequencies log(1 + N / (1 + df)); the last entry is that of any other word."""
        df = np.array([frequencies.get(int(h), 0) for h in self.vocabulary.view(np.int64)] + [0])
        self.idf = np.log1p(files / (1 + df))
        vectors = self.counts * self.idf[:-1]
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def best(self, words: np.ndarray, owner: np.ndarray, passages: int, threshold: float) -> dict[int, tuple[float, int]]:
        """Best template (cosine, its index) of each passage that reaches the threshold; `owner` is the passage of each word."""
        size = len(self.vocabulary)
        places = self.places(words)
        known = places < size
        if not known.any():
            return {}
        # squared norm: term frequencies are summed per distinct word of a passage
        order = np.lexsort((words, owner))
        o, w = owner[order], words[order]
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1]))))
        tf = np.diff(np.append(first, len(w)))
        place = places[order][first]
        weight = (tf * self.idf[place]) ** 2
        total = np.bincount(o[first], weight, passages)
        inside = np.bincount(o[first], weight * (place < size), passages)
        out = {}
        for p in np.flatnonzero((inside >= threshold**2 * total) & (total > 0)):
            mine = (o[first] == p) & (place < size)
            cosines = self.vectors[:, place[mine]] @ (tf[mine] * self.idf[place[mine]]) / np.sqrt(total[p])
            k = int(cosines.argmax())
            if cosines[k] >= threshold:
                out[int(p)] = float(cosines[k]), k
        return out


def _passages(text: bytes, starts: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges of the lines, of paragraphs with several lines and of the whole text."""
    data = np.frombuffer(text, np.uint8)
    cuts = np.searchsorted(starts, np.flatnonzero(data == 10)).tolist()
    lines = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(starts)])]
    out, open_at = [], None
    for a, b in [*lines, (0, 0)]:
        if b > a:
            out.append((a, b))
            open_at = (open_at[0], b, open_at[2] + 1) if open_at else (a, b, 1)
        elif open_at:
            if open_at[2] > 1:
                out.append(open_at[:2])
            open_at = None
    whole = (0, len(starts))
    return out if whole in out or not len(starts) else [*out, whole]


def _document_frequencies(files: DataFrame, templates: Templates) -> dict[int, int]:
    def count(batches):
        total = np.zeros(len(templates.vocabulary) + 1, np.int64)
        for batch in slices(batches, SLICE):
            for words, _, _ in hash_words(text_bytes(batch.column("text")), LETTERS_DIGITS):
                total[np.unique(templates.places(words))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(templates.vocabulary.view(np.int64)), pa.array(total[:-1])], names=["word", "df"])

    return {r.word: r.df for r in files.mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}  # one row per word of the templates


def match_licenses(files: DataFrame, text_col: str = "text", notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, whole: list[tuple[str, str]] | None = None) -> DataFrame:
    """The files with `license`, `license_score` (null without one) and `license_from` = 'own' for the passage nearest to a template."""
    notices, whole = notices or NOTICES, whole or TEXTS
    templates = Templates(notices), Templates(whole)
    texts = files.select(F.col(text_col).cast("string").alias("text"))
    frequencies, n = _document_frequencies(texts, Templates([*notices, *whole])), texts.count()
    for t in templates:
        t.weigh(frequencies, n)
    shared = files.sparkSession.sparkContext.broadcast(templates)
    kept = [c for c in files.columns if c not in {f.name for f in FOUND}]
    schema = T.StructType([*(files.schema[c] for c in kept), *FOUND])
    arrow = to_arrow_schema(schema)

    def match(batches):
        short, long = shared.value
        for batch in slices(batches, SLICE):
            names, scores = [], []
            texts = text_bytes(batch.column(text_col).cast(pa.string()))
            for text, (words, starts, _) in zip(texts, hash_words(texts, LETTERS_DIGITS)):
                best, t = (0.0, 0), long
                if len(words):
                    best = _best_passage(long, [(0, len(words))], words, max(threshold, WHOLE_THRESHOLD))
                    if not best[0]:
                        best, t = _best_passage(short, _passages(text, starts), words, threshold), short
                names.append(t.names[best[1]] if best[0] else None)
                scores.append(best[0] or None)
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n and "own" for n in names], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], schema=arrow)

    return files.mapInArrow(match, schema)


def _best_passage(t: Templates, passages: list[tuple[int, int]], words: np.ndarray, threshold: float) -> tuple[float, int]:
    lines = np.array(passages)
    sizes = lines[:, 1] - lines[:, 0]
    known = np.concatenate(([0], np.cumsum(t.places(words) < len(t.vocabulary))))
    # with k known and u other words, cos**2 <= sum(known) / (sum(known) + u * idf_max**2), and sum(known) <= (k * idf_max)**2
    k = known[lines[:, 1]] - known[lines[:, 0]]
    maybe = np.flatnonzero(k.astype(float) ** 2 * (1 - threshold**2) >= threshold**2 * (sizes - k))
    maybe = maybe[k[maybe] > 0]
    if not len(maybe):
        return 0.0, 0
    index = np.concatenate([np.arange(a, b) for a, b in lines[maybe]])
    found = t.best(words[index], np.repeat(np.arange(len(maybe)), sizes[maybe]), len(maybe), threshold)
    return max(found.values(), key=lambda f: (round(f[0], 12), -f[1]), default=(0.0, 0))


def is_license_path(path: Column) -> Column:
    """Does the name of the file, without what follows a dot or dash, say that it holds the licence of its directory?"""
    return F.coalesce(path, F.lit("")).rlike("(?i)(?:^|/)(?:un)?(?:licen[cs]es?|copying)(?:[.-][^/]*)?$")


def inherit_licenses(matched: DataFrame, path_col: str = "path", file_col: str = "is_license_file") -> DataFrame:
    """Gives files without a licence the one of the nearest directory at or above theirs that holds a licence file with one.  Adds `license_dir`, the
    directory it came from (null for own licences), and sets `license_from` to 'inherited'."""
    directory = F.regexp_extract(F.coalesce(F.col(path_col), F.lit("")), "^(.*)/[^/]*$", 1)
    files = matched.drop("license_dir", "_dir").withColumn("_dir", directory)
    given = files.filter(F.col(file_col) & F.col("license").isNotNull()).groupBy(F.col("_dir").alias("up")).agg(
        F.min(F.struct((-F.col("license_score")).alias("worse"), F.col("license"))).alias("best")).select("up", F.col("best.license").alias("dir_license"), (-F.col("best.worse")).alias("dir_score"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    ancestors = files.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = ancestors.join(given, "up").groupBy("_dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "dir_license", "dir_score")).alias("near"))
    joined = files.join(nearest, "_dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(*(c for c in files.columns if c not in {f.name for f in FOUND} | {"_dir"}),
                         F.coalesce("license", "near.dir_license").alias("license"), F.coalesce("license_score", "near.dir_score").alias("license_score"),
                         F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("license_from"), F.when(~own, F.col("near.up")).alias("license_dir"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", file_col: str = "is_license_file", stored: bool = True, **how) -> DataFrame:
    """Match and inherit; the matches (without texts) are stored in between, as three joins read them."""
    matched = match_licenses(files, text_col, **how).drop(text_col)
    return inherit_licenses(checkpointed(matched, "licences") if stored else matched, path_col, file_col)
