"""Bag search against a brute-force ranking: copies, ties, odd rows, blocks of items, hash collisions, empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsweave.llm import bag_search
from newsweave.llm.common import LETTERS_DIGITS, hash_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(terms(text)), len(terms(text))) for i, text in docs]
    bags = [b for b in bags if b[2]]
    n_docs, length = len(bags), sum(b[2] for b in bags)
    holding = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        wanted = set(terms(text))
        scored = []
        for i, bag, n in bags:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found_rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k,block_terms,cells", [(50, 200_000, 1 << 22), (3, 40, 64), (1, 1, 1)])
def test_bag_search_equals_brute_force(spark, k, block_terms, cells, monkeypatch):
    monkeypatch.setattr(bag_search, "CELLS", cells)
    rng = random.Random(k)
    words = ["Alpha", "beta", "été", "ÉTÉ", "x1", "naïve", "été2", "delta", "Gamma", "the", "of", "z"]
    docs = [(i, rng.choice([", ", " ", "\n", "--"]).join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(400)]
    docs += [(1_000 + i, "the BETA of delta the") for i in range(150)] + [(2_000, None), (2_001, "!!"), (2_002, "alpha " * 20_000), (5, "alpha beta"), (5, "alpha beta"), (5, "delta the"), (None, "alpha beta")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices([*words, "absent", "Alpha,beta"], k=rng.randrange(0, 6)))) for i in range(12)]
    items += [(90, None), (91, "..."), (92, "beta BETA alpha"), (92, "beta"), (None, "delta the of"), (93, "nowhere")]
    table = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, item_id string").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int").repartition(2)
    assert found_rows(bag_search.search(table, asked, k, block_terms=block_terms)) == sorted(brute(docs, items, k), key=repr)


def test_bag_search_on_given_tables(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    wanted = brute(docs, [(r.item_id, r.text) for r in items.collect()], 50)
    assert found_rows(bag_search.search(documents, items)) == sorted(wanted, key=repr)


def test_words_are_verified_on_their_bytes():
    class Row:
        def __init__(self, item, word, number):
            self.item, self.word, self.hash = item, word, number

    text = b"one two three two one"
    hashes, starts, ends = next(hash_words([text], LETTERS_DIGITS))
    one, two, three = (int(hashes[i]) for i in range(3))
    known = bag_search.Vocabulary([Row(1, b"one", one), Row(1, b"xyz", one), Row(2, b"owt", two), Row(2, b"three", three), Row(3, b"thre", three)])
    assert known.same == 2
    place, number = known.find(np.frombuffer(text, np.uint8), hashes, starts, ends)
    assert sorted(place.tolist()) == [0, 2, 4]  # `two` has the hash of another word
    assert [known.bytes[known.starts[i] : known.starts[i] + known.lengths[i]].tobytes() for _, i in sorted(zip(place.tolist(), number.tolist()))] == [b"one", b"three", b"one"]


def test_large_sums_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(bag_search, "EXACT_DOUBLE", 1)
    docs = [(i, "a b c d" if i % 2 else "a b b") for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert found_rows(bag_search.search(table, items, 5)) == sorted(brute(docs, [(1, "a b c")], 5), key=repr)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "alpha")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for d, i in ((none, items), (docs, no_items), (none, no_items), (spark.createDataFrame([(1, None)], docs.schema), items)):
        assert bag_search.search(d, i).count() == 0
    assert found_rows(bag_search.search(docs, items)) == sorted(brute([(1, "alpha")], [(1, "alpha")], 50))
