"""Exact and near deduplication against brute force, on odd rows and with tiny tables, blocks and fingerprints."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsweave.llm import components, grace_dedup, hamming_dedup
from newsweave.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return sorted((i, max(g), len(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("fingerprint,table_bytes", [(grace_dedup.sha256, 1 << 26), (lambda c: bytes(31) + bytes([len(c) % 3]), 1 << 26), (grace_dedup.sha256, 2000)])
def test_grace_dedup_equals_brute_force(documents, fingerprint, table_bytes):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = grace_dedup.exact_duplicate_classes(documents.coalesce(1), fingerprint=fingerprint, table_bytes=table_bytes)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == exact_brute(rows)
    kept = grace_dedup.drop_exact_duplicates(documents, fingerprint=fingerprint, table_bytes=table_bytes)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _ in exact_brute(rows)})


def test_grace_buckets_spill_and_compare_contents():
    import pyarrow as pa

    words = [f"{'x' * 50}{i % 400}" for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": words, "_row": list(range(2000)), "_fingerprint": [grace_dedup.sha256(w.encode()) for w in words], "_copies": [1] * 2000})
    runner = grace_dedup.GraceBuckets("id", "text", 4000)
    tables = list(runner.run(iter([batch.slice(i, 100) for i in range(0, 2000, 100)])))
    assert runner.spilled > 1 and len(tables) > 8
    assert sorted((t, n) for b in tables for t, n in zip(b["text"].to_pylist(), b["_copies"].to_pylist())) == sorted((f"{'x' * 50}{i}", 5) for i in range(400))
    assert {i for b in tables for i in b["id"].to_pylist()} == set(range(1600, 2000))


def test_grace_dedup_on_odd_rows(odd):
    found = {(r.doc_id, r.kept): r for r in grace_dedup.exact_duplicate_classes(odd("keep_id")).collect()}
    assert found[(7, True)].group_size == 3 and found[(5, False)].keep_id == 7
    assert found[(3, True)].group_size == 2 and found[(2, False)].keep_id == 3
    assert found[(None, True)].group_size == 1
    kept = grace_dedup.drop_exact_duplicates(odd("fingerprint"))
    assert kept.columns[-1] == "fingerprint" and kept.count() == 7
    assert grace_dedup.drop_exact_duplicates(odd(rows=[])).count() == 0 and grace_dedup.exact_duplicate_classes(odd(rows=[])).count() == 0
    twice = odd(rows=[(1, "same", None, None, None)] * 4)
    assert grace_dedup.drop_exact_duplicates(twice).count() == 1 and grace_dedup.exact_duplicate_classes(twice).filter("kept").count() == 1


def near_brute(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def crowd(seed=3):
    """A crowd of copies with one to twelve changed words, and chains of small changes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randint(0, 12) if i < 130 else 3):
            copy[rng.randrange(len(copy))] = word()
        if i >= 130:
            base = copy
        rows.append((i * 3 + 1, " ".join(copy)))
    return rows + [(1000 + i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(2000 + i, rows[i][1].upper()) for i in range(40)]


@pytest.mark.parametrize("block", [512, 16])
def test_near_dedup_equals_brute_force(spark, block):
    rows = crowd()
    found = hamming_dedup.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == near_brute(rows)
    assert found.filter("kept <> (doc_id = component_id)").count() == 0


def test_near_dedup_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    kept = hamming_dedup.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in near_brute(rows)})


def test_near_dedup_on_odd_rows(odd):
    found = hamming_dedup.near_duplicate_components(odd("row")).collect()
    by_id = {(r.doc_id, r.kept): (r.n_shingles, r.component_id) for r in found}
    assert by_id[(2, True)] == (0, 2) and by_id[(3, True)] == (0, 3) and by_id[(4, True)] == (1, 4)
    assert by_id[(5, True)][1] == by_id[(5, False)][1] == by_id[(7, False)][1] == 5
    assert by_id[(None, True)][1] is None and by_id[(9, True)] == (1, 9) and by_id[(10, True)] == (1, 10)
    assert hamming_dedup.drop_near_duplicates(odd("set")).count() == 8
    assert hamming_dedup.near_duplicate_components(odd(rows=[])).count() == 0


def test_keys_meet_at_the_distance_threshold():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, hamming_dedup.COMPONENTS).astype("<u2")
        b = a.copy()
        b[rng.choice(hamming_dedup.COMPONENTS, 15, replace=False)] ^= 1
        batch = pa.RecordBatch.from_pydict({"row": [0, 1], "signature": [a.tobytes(), b.tobytes()]})
        keys = next(iter(hamming_dedup._keys([batch]))).to_pandas()
        assert set(keys[keys.row == 0].key) & set(keys[keys.row == 1].key)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(50)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("order", ["ascending", "shuffled", "star"])
def test_long_chains_need_few_rounds(spark, monkeypatch, order):
    n = 1000
    ids = list(range(n)) if order != "shuffled" else random.Random(3).sample(range(n), n)
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1)] if order != "star" else [(n, i) for i in range(n)]
    stored, gone = [], []
    keep, drop = components.checkpointed, components.forget
    monkeypatch.setattr(components, "checkpointed", lambda df, name: stored.append(name) or keep(df, name))
    monkeypatch.setattr(components, "forget", lambda *tables: gone.extend(tables) or drop(*tables))
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == dict.fromkeys({v for e in edges for v in e}, 0)
    assert stored.count("edges") <= 12 and len(gone) == len(stored) - 1  # only the answer is left
