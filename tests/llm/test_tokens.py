"""Token files, byte-level BPE and the language model against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsweave.llm import byte_bpe, recurrent_lm, token_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_bpe_equals_tiktoken_and_decodes(documents, odd, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (documents.select("doc_id", "text"), odd("ids").select("doc_id", "text", "ids"), odd(rows=[])):
        want = Counter()
        for r in docs.collect():
            ids = np.array(own.encode_ordinary(r.text or ""), "<u4").tobytes()
            want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        found = byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    encoded = byte_bpe.encode(odd("ids"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded.withColumn("decoded", F.lit(1)), ranks)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()) == Counter((r.doc_id, r.text or "") for r in odd().collect())
    assert encoded.columns == ["doc_id", "lang", "source", "ids"] and encoded.filter("doc_id = 10").first().ids == own.encode_ordinary("a")


def test_pieces_of_long_texts_join_up(ranks, monkeypatch):
    import regex

    monkeypatch.setattr(byte_bpe, "PIECE", 50)
    rng, find = random.Random(4), regex.compile(public_tokenizers.PATTERN).findall
    for _ in range(300):
        text = "".join(rng.choices(["a", "bc", " ", "  ", "\n", "'s", "é", "1", "!", "\t ", " "], k=rng.randint(0, 400)))
        assert [w for p in byte_bpe._pieces(text) for w in find(p)] == find(text)


def test_token_files_equal_the_library(documents, odd, definition, tmp_path):
    library = Tokenizer.from_str(definition)
    for n, docs in enumerate((documents, odd("start"))):
        manifest = token_files.write_token_files(docs, definition, end_id=2, folder=str(tmp_path / str(n)), length=64, sequences=4)
        found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
        at, want = 0, Counter()
        for r in docs.collect():
            ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in found) == want
        assert [r.id for r in found] == sorted((r.id for r in found), key=lambda i: (i is not None, i))
        for r in found:
            assert r.start == at
            at += r.n_tokens
        shard = manifest.orderBy("shard").first()
        file = token_files.SequenceFile(shard.path)
        assert sum(sum(file.mask(i).to_pylist()) for i in range(len(file))) == shard.n_tokens
        assert all(len(file.sequence(i)) == 64 for i in range(len(file))) and not file.sequence(0).flags.owndata
        whole = np.concatenate([file.sequence(i) for i in range(len(file))])
        for a, b in ((0, len(whole)), (10, len(whole) - 7), (63, 64), (5, 5)):
            assert np.array_equal(file.span(a, b), whole[a:b])
        assert len(list((tmp_path / str(n)).iterdir())) == 2 * manifest.count()
    empty = token_files.write_token_files(odd(rows=[]), definition, end_id=2)
    assert token_files.read_token_files(empty).count() == 0


def test_word_encoder_equals_the_library_on_odd_characters(definition):
    library, own, rng = Tokenizer.from_str(definition), token_files.WordEncoder(definition), random.Random(1)
    assert own.by_word
    alphabet = [*"aB é É'1² Ⅷ ǅ İ ſ ß ́ 　\x1c\x0b\x85​가ㄱ漢 _-.,!?(\n\t🙂ﬁÅΩ<|", "<|endoftext|>", "word", "'s", "n't,", "I'LL "]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert [int(i) for p in own.encode(text) for i in p] == library.encode(text, add_special_tokens=False).ids


def test_language_model(documents, odd):
    docs = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) + [None] for r in documents.collect()}
    learned = Counter(w for i, words in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words)
    n, v = sum(learned.values()), len(learned)
    found = recurrent_lm.score_documents(documents).collect()
    assert len(found) == len(docs)
    for r in found:
        words = docs[r.doc_id]
        base = sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(learned[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    strange = recurrent_lm.score_documents(odd("score")).collect()
    assert len(strange) == 10 and {r.n_tokens for r in strange if r.doc_id in (2, 3)} == {1}
    assert recurrent_lm.score_documents(odd(rows=[])).count() == 0


def test_state_is_carried_and_gradients_are_right():
    v = recurrent_lm.Vocabulary([(i * 7919 + 1, 50 - i) for i in range(40)], 10, 1900, 60)
    w, rng = recurrent_lm.start_weights(v), np.random.default_rng(0)
    documents = [np.append(rng.integers(0, 42, n), v.end).astype(np.int32) for n in (5, 70, 0, 33, 200)]
    together = recurrent_lm.score(w, documents, v.end)
    for d, total in zip(documents, together):  # one after the other, step by step
        h, before, alone = np.zeros((1, recurrent_lm.HIDDEN), np.float32), v.end, 0.0
        for t in d:
            h, _ = recurrent_lm._step(w, np.array([before]), h)
            alone += recurrent_lm.output_log_probability(w, h, np.array([t]), v.end)[0][0]
            before = t
        assert math.isclose(alone, total, rel_tol=1e-4)
    trained = {k: x.copy() for k, x in w.items()}
    squares = recurrent_lm.start_squares(w)
    for _ in range(20):
        recurrent_lm.train(trained, documents, v.end, squares)
    assert recurrent_lm.score(trained, documents, v.end).sum() > together.sum() + 100
    states = rng.normal(0, 1, (6, recurrent_lm.HIDDEN)).astype(np.float32)
    targets, gradient = np.array([0, 39, 40, 41, 5, 33]), {}
    _, back = recurrent_lm.output_log_probability(trained, states, targets, v.end, gradient)
    for _ in range(10):
        i, j, eps = rng.integers(6), rng.integers(recurrent_lm.HIDDEN), 1e-2
        moved = [states.copy(), states.copy()]
        moved[0][i, j] += eps
        moved[1][i, j] -= eps
        up, down = (-recurrent_lm.output_log_probability(trained, m, targets, v.end)[0].sum() for m in moved)
        assert abs((up - down) / (2 * eps) - back[i, j]) < 1e-2


def test_training_takes_every_token_once_and_carries_the_state():
    rng = np.random.default_rng(1)
    documents = [np.append(rng.integers(0, 40, n), 40).astype(np.int32) for n in (0, 3_000, 5, 17, 900, *rng.integers(0, 60, 400))]
    seen, running = [], {}
    for live, targets, begins, used in recurrent_lm._windows(iter(documents), 40):
        assert targets.shape == begins.shape == used.shape == (recurrent_lm.WINDOW, len(live))
        for j, lane in enumerate(live):
            for t, first, here in zip(targets[:, j].tolist(), begins[:, j].tolist(), used[:, j].tolist()):
                if here:
                    if first:
                        seen.append(running.pop(lane, []))
                    running.setdefault(lane, []).append(t)
    seen += running.values()
    assert sorted(map(tuple, filter(len, seen))) == sorted(tuple(d.tolist()) for d in documents)  # a document stays in its lane, whole and in order
    v = recurrent_lm.Vocabulary([(i * 7919 + 1, 50 - i) for i in range(40)], 10, 1900, 60)
    w = recurrent_lm.start_weights(v)
    assert recurrent_lm.train(w, documents, v.end, recurrent_lm.start_squares(w)) == sum(map(len, documents))


def test_large_counts_keep_their_width():
    import pyarrow as pa
    import zstandard

    words = np.array([5, 9], np.int64)
    block = lambda counts: recurrent_lm._pack(np.concatenate((words, np.array(counts, np.int64))))
    for counts in ([3, 4], [1 << 40, 7]):
        batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0, 0], pa.int32()), "chunk": [0, 1], "payload": [block(counts), block([1, 1])]})
        out = next(recurrent_lm._sum_counts(None, 1)(iter([batch])))
        for payload in out.column("payload").to_pylist()[:2]:
            assert np.frombuffer(zstandard.decompress(payload[3:]), payload[:3].decode()).tolist() == [counts[0] + 1, counts[1] + 1]
    assert recurrent_lm.vocabulary_size(10) == 1_024 and recurrent_lm.vocabulary_size(4_000_000) > recurrent_lm.vocabulary_size(400_000) > 3_000


def test_vocabulary_rows_come_from_few_words():
    import pyarrow as pa

    counts = np.array([1, 1, 2, 3, 3, 4, 7, 8, 1 << 40, 1 << 33])
    pairs = np.stack((np.arange(10), counts), axis=1)
    batch = pa.RecordBatch.from_pydict({"payload": [recurrent_lm._pack(np.concatenate(([10, int(counts.sum())], pairs.ravel())).astype(np.int64))]})
    rows = lambda *how: [(a, b) for x in recurrent_lm._summaries(*how)(iter([batch])) for a, b in zip(*x.to_pydict().values())]
    assert rows("totals") == [(10, int(counts.sum()))] and rows("levels") == [(0, 2), (1, 3), (2, 2), (3, 1), (33, 1), (40, 1)]
    for size in range(1, 12):
        least = recurrent_lm._least_count(rows("levels"), size)
        assert sorted(b for _, b in rows("words", least))[-size:] == sorted(counts.tolist())[-size:]


def test_logits_are_exponentiated_once(monkeypatch):
    """The cost of training: one exponential for each class, each word of the target's class and each gate of a token."""
    v = recurrent_lm.Vocabulary([(i * 7919 + 1, 4_000 - i) for i in range(3_600)], 400, 8_000_000, 5_000)
    rng, seen, exp = np.random.default_rng(2), [], np.exp
    documents = [np.append(rng.integers(0, 3_600, 159), v.end).astype(np.int32) for _ in range(recurrent_lm.LANES)]
    w = recurrent_lm.start_weights(v)
    monkeypatch.setattr(np, "exp", lambda x, *args, **how: (seen.append(np.size(x)), exp(x, *args, **how))[1])
    tokens = recurrent_lm.train(w, documents, v.end, recurrent_lm.start_squares(w))
    assert tokens == 160 * recurrent_lm.LANES and sum(seen) <= tokens * (v.classes + 2 + v.size + 2 * recurrent_lm.HIDDEN)


def test_steps_of_the_cheaper_training():
    rng = np.random.default_rng(3)
    for low, high in ((0, 1), (-300, -200), (200, 300), (-200, 300)):
        x = rng.uniform(low, high, (5, 7)).astype(np.float32)
        for axis in (0, 1):
            e, sums, logs = recurrent_lm._exponentials(x, axis)
            assert np.allclose(logs, np.log(np.exp(x.astype(float)).sum(axis=axis)), rtol=1e-5, atol=1e-5) and np.allclose((e / np.expand_dims(sums, axis)).sum(axis=axis), 1, atol=1e-5)
    rows, first = rng.normal(0, 1, (60, 3)).astype(np.float32), np.array([0, 1, 3, 20, 28, 37])
    assert np.allclose(recurrent_lm._sums(rows, first), np.add.reduceat(rows, first, axis=0), atol=1e-5)
    hashes = [rng.integers(0, 50, n).astype(np.uint64) for n in (0, 40, 3)]
    words, places = recurrent_lm._distinct(hashes, 4)
    assert (words[places] == np.concatenate(hashes)).all() and words.tolist() == sorted(set(words.tolist()), key=lambda x: (x % 4, x))
