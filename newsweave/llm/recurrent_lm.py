"""Gated recurrent language model with a class-factored output, and the unigram score it is held against.

Counting: the words of all training documents are counted in Spark (by 64-bit hash, summed per chunk before the shuffle), and each chunk gets
the counts of its own words back, as many numbers as it has distinct words.  So what is gathered grows with the corpus.

Model: a GRU reads the documents word by word.  Its vocabulary is the most frequent words (256 times the fifth root of the number of distinct words, so it grows with the corpus), the end sign and
one sign for all other words.  The output is P(class | state) * P(word | class, state): words form classes in order of frequency, about as many as a class has words; another word is
drawn from the class of all others by its smoothed count.  The output starts at the unigram distribution.  Training is truncated
backpropagation in numpy.  Every training document is learned once: by hash the documents fall to `rounds` parts, every partition trains on its documents of the part, and weights and
step sizes are averaged by tokens after each round.  Documents run side by side in lanes; a lane takes the next document when one ends, and the state is carried
from window to window through the whole document.

Scoring: documents run side by side in lanes, windows follow each other with the state carried, and the state is cleared where a document
begins, so the log-likelihood covers complete documents.

Defined results: null text counts as empty and consists of the end sign alone; without training documents all counts are 0 and the model stays at its start; repeated rows are counted and scored
each on their own; an empty table gives an empty result; columns of the input other than the id play no part."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.byte_bpe import packed_documents, text_chunks, unpacked_documents
from newsweave.llm.common import NOT_SPACE, crc_column, hash_words, text_bytes
from newsweave.session import checkpointed

CHUNK = 16 << 20
HIDDEN = 24
LANES, WINDOW = 128, 16  # of training
SCORE_LANES, SCORE_WINDOW = 256, 64
BLOCK = 2_048  # tokens whose probabilities are computed at once
STEPS = 8  # whose inputs are looked up at once
LONG = 2_048  # words; longer documents start first, so that no lane is left with one at the end
LEAST_VOCABULARY = 1_024
DOCUMENTS_PER_BUCKET = 200_000  # of the counts: a bucket holds a part of the words of that many documents
RATE, FIRST_SQUARE = 0.05, 1e-6
AVERAGERS = 16
AHEAD = 1_024  # tokens of a lane that are laid out for the next windows
_FIRST = 1 << 32  # marks the first token of a document

Weights = dict[str, np.ndarray]


class Vocabulary:
    """The most frequent words by hash, in order of frequency, and what is known about all others."""

    def __init__(self, words: list[tuple[int, int]], ends: int, total: int, distinct: int):
        self.hashes = np.array([w for w, _ in words], np.int64).view(np.uint64)
        self.counts = np.array([c for _, c in words], np.int64)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.end, self.other = len(words), len(words) + 1
        self.ends = ends
        self.total, self.distinct = total + ends, distinct + (ends > 0)  # of all tokens, the end included
        self.other_norm = total - int(self.counts.sum()) + distinct - len(words) + 1
        self.size = max(8, round(len(words) ** 0.5 / 8) * 8)  # words of a class
        self.classes = -(-len(words) // self.size)  # then the end, then all others

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.end:
            return np.full(len(hashes), self.other, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.end - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.other).astype(np.int32)


def start_weights(v: Vocabulary) -> Weights:
    rng, size, classes = np.random.default_rng(17), v.other + 1, v.classes + 2
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    words = np.full(v.classes * v.size, -1e4, np.float32)
    words[: v.end] = np.log(v.counts + 1)
    mass = [*(np.exp(words.astype(np.float64)).reshape(v.classes, v.size).sum(axis=1)), v.ends + 1, v.other_norm]
    w = {"input": small(size, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32), "state": small(HIDDEN, 3 * HIDDEN), "class": np.zeros((HIDDEN + 1, classes), np.float32), "word": np.zeros((v.classes, HIDDEN + 1, v.size), np.float32)}  # the last unit of the output is always 1
    w["class"][HIDDEN], w["word"][:, HIDDEN] = np.log(np.array(mass)), words.reshape(v.classes, v.size)
    return w


def _states(w: Weights, ids: np.ndarray, begins: np.ndarray, h: np.ndarray, parts: bool = False):
    """States (time x unit x lane) after each of the inputs (time x lane), and with `parts` what the way back needs of each step: the state before, gates, candidate and its recurrent part.
    `h`: the state before the first (unit x lane).  Units come before lanes, so that each gate is one block of memory."""
    n, width = ids.shape
    slots = range(n) if parts else [0] * n
    turned = w["state"].T.copy()
    turned[: 2 * HIDDEN] *= -1  # what the sigmoid takes the exponential of
    stays, some = (~begins).astype(np.float32), begins.any(axis=1).tolist()
    out, first = np.empty((n, HIDDEN, width), np.float32), np.ascontiguousarray(h)
    new, gates, s = (np.empty((slots[-1] + 1, k * HIDDEN, width), np.float32) for k in (1, 2, 3))
    h = first
    with np.errstate(over="ignore"):
        for t, i in enumerate(slots):
            if t % STEPS == 0:
                x = w["input"].take(ids[t : t + STEPS].ravel(), axis=0)
                x += w["bias"]
                x[:, : 2 * HIDDEN] *= -1
                x = np.ascontiguousarray(x.reshape(-1, width, 3 * HIDDEN).transpose(0, 2, 1))
            before, candidate, gate, recurrent, xt = h * stays[t] if some[t] else h, new[i], gates[i], s[i], x[t % STEPS]
            np.dot(turned, before, out=recurrent)
            np.add(xt[: 2 * HIDDEN], recurrent[: 2 * HIDDEN], out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(gate[HIDDEN:], recurrent[2 * HIDDEN :], out=candidate)
            candidate += xt[2 * HIDDEN :]
            np.tanh(candidate, out=candidate)
            h = out[t]
            np.subtract(before, candidate, out=h)
            h *= gate[:HIDDEN]
            h += candidate
    if not parts:
        return out, None
    old = np.concatenate((first[None], out[:-1])) * stays[:, None]
    return out, (old, gates[:, :HIDDEN], gates[:, HIDDEN:], new, s[:, 2 * HIDDEN :])


def _step(w: Weights, ids: np.ndarray, h: np.ndarray):
    """One step of lanes (lane x unit)."""
    states, parts = _states(w, ids[None], np.zeros((1, len(ids)), bool), h.T, True)
    return states[0].T, tuple(x[0].T for x in parts)


def _inputs(targets: np.ndarray, begins: np.ndarray, last: np.ndarray, v_end: int) -> np.ndarray:
    """What the network reads before each target: the token before, or the end sign where a document begins."""
    return np.where(begins, v_end, np.concatenate((last[None], targets[:-1])))


def class_of(ids: np.ndarray, v_end: int, classes: int, size: int) -> np.ndarray:
    return np.where(ids < v_end, ids // size, classes + (ids > v_end))


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of the given places (ascending, the first is 0) to the next.  Most are of a few rows: these are added place by place."""
    out, times = rows[first], np.append(first[1:], len(rows)) - first
    ones = np.ones(times.max(initial=0), np.float32)
    for i in np.flatnonzero(times > 8).tolist():
        np.dot(ones[: times[i]], rows[first[i] : first[i] + times[i]], out=out[i])
    some = np.flatnonzero((times > 1) & (times <= 8))
    for j in range(1, 8):
        some = some[times[some] > j]
        if not len(some):
            break
        out[some] += rows[first[some] + j]
    return out


def _exponentials(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the numbers up to a factor for each line along the axis, their sums, and the logarithms of the sums without the factor.  It is 1 unless the numbers are too large or too small for that."""
    total = lambda e: e.sum(axis=0) if axis == 0 else e @ np.ones(e.shape[1], np.float32)
    with np.errstate(over="ignore"):
        out = np.exp(x)
    sums = total(out)
    if sums.min(initial=1) > 1e-25 and sums.max(initial=1) < 1e30:
        return out, sums, np.log(sums)
    top = x.max(axis=axis, keepdims=True)
    out = np.exp(x - top)
    sums = total(out)
    return out, sums, np.log(sums) + top.squeeze(axis)


def output_log_probability(w: Weights, states: np.ndarray, targets: np.ndarray, v_end: int, gradient: Weights | None = None):
    """Natural log of P(class) * P(word | class) of each target; with `gradient`, fills it (the words' parts for the classes `touched`)
    and returns the gradient by the states of the negative sum."""
    classes, _, size = w["word"].shape
    kinds = class_of(targets, v_end, classes, size)
    rows, out, back = np.arange(len(targets)), np.empty(len(targets)), None
    states = np.concatenate((states, np.ones((len(states), 1), np.float32)), axis=1)
    if gradient is not None:
        gradient["class"], back = np.zeros_like(w["class"]), np.empty((len(states), HIDDEN), np.float32)
    for at in range(0, len(targets), BLOCK):
        own = slice(at, at + BLOCK)
        here, goals = states[own], (kinds[own], rows[: len(targets) - at][:BLOCK])
        x = w["class"].T @ here.T  # class x token
        logs = x[goals]
        x, sums, norm = _exponentials(x, 0)
        out[own] = logs - norm
        if gradient is not None:
            x *= 1 / sums
            x[goals] -= 1
            gradient["class"] += (x @ here).T
            np.dot(x.T, w["class"][:HIDDEN].T, out=back[own])
    order = np.argsort(kinds.astype(np.uint16) if classes < 65_000 else kinds, kind="stable")
    cuts = np.searchsorted(kinds[order], np.arange(classes + 1))
    times = np.diff(cuts)
    touched = np.flatnonzero(times)
    spans = [(k, slice(x, y)) for k, x, y in zip(touched.tolist(), cuts[touched].tolist(), cuts[touched + 1].tolist())]
    order = order[: cuts[-1]]  # words of the vocabulary, class by class
    kinds, rows, some = kinds[order], rows[: cuts[-1]], np.ascontiguousarray(states[order])
    places = targets[order] - kinds * size
    y = np.empty((len(order), size), np.float32)
    for k, own in spans:
        np.dot(some[own], w["word"][k], out=y[own])
    logs = y[rows, places]
    y, sums, norm = _exponentials(y, 1)
    out[order] += logs - norm
    if gradient is not None:
        y *= (1 / sums)[:, None]
        y[rows, places] -= 1
        word, by_state = np.empty((len(touched), *w["word"].shape[1:]), np.float32), np.empty((len(some), HIDDEN), np.float32)
        for i, (k, own) in enumerate(spans):
            np.dot(some[own].T, y[own], out=word[i])
            np.dot(y[own], w["word"][k, :HIDDEN].T, out=by_state[own])
        back[order] += by_state
        gradient["touched"], gradient["word"] = touched, word
    return out, back


def _lanes(documents: list[np.ndarray], end: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents (ids with the end) dealt to lanes of about equal length, longest lane first: targets (time x lane), owner of each (or -1), whether a document
    begins, and the lengths of the lanes.  Long documents go first."""
    loads, places = np.zeros(lanes, np.int64), []
    for d in np.argsort([-len(x) for x in documents], kind="stable"):
        lane = int(loads.argmin())
        places.append((int(d), lane, int(loads[lane])))
        loads[lane] += len(documents[d])
    order = np.argsort(-loads, kind="stable")
    rank = np.empty(lanes, np.int64)
    rank[order] = np.arange(lanes)
    targets, owner = np.full((int(loads.max(initial=0)), lanes), end, np.int32), np.full((int(loads.max(initial=0)), lanes), -1, np.int32)
    begins = np.zeros(targets.shape, bool)
    for d, lane, at in places:
        targets[at : at + len(documents[d]), rank[lane]] = documents[d]
        owner[at : at + len(documents[d]), rank[lane]] = d
        begins[at, rank[lane]] = True
    return targets, owner, begins, np.sort(loads)[::-1]


def _windows(documents: Iterable[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows over lanes that each take the next document when one ends: the lanes that go on, and (time x lane) targets, whether a document begins, and whether there is a token."""
    queue, more = iter(documents), True
    held, at, upto = np.zeros((LANES, AHEAD), np.int64), np.zeros(LANES, np.int64), np.zeros(LANES, np.int64)  # tokens ahead of each lane, as far as there is room
    rest = [np.zeros(0, np.int64)] * LANES  # of the documents that they come from
    steps = np.arange(WINDOW)
    while True:
        for i in np.flatnonzero(upto - at < WINDOW).tolist():
            n = int(upto[i] - at[i])
            held[i, :n] = held[i, at[i] : upto[i]].copy()
            while n < WINDOW:
                if not len(rest[i]):
                    document = next(queue, None) if more else None
                    if document is None:
                        more = False
                        break
                    rest[i] = document.astype(np.int64)
                    rest[i][0] += _FIRST
                some, rest[i] = rest[i][: AHEAD - n], rest[i][AHEAD - n :]
                held[i, n : n + len(some)] = some
                n += len(some)
            at[i], upto[i] = 0, n
        live = np.flatnonzero(upto > at)
        if not len(live):
            return
        places = at[live] + steps[:, None]
        used = places < upto[live]
        tokens = np.where(used, held[live, np.minimum(places, AHEAD - 1)], end)
        at[live] = np.minimum(at[live] + WINDOW, upto[live])
        yield live, (tokens & (_FIRST - 1)).astype(np.int32), tokens >= _FIRST, used


def _update(w: np.ndarray, squares: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
    """One step of Adagrad on some rows."""
    some = squares[at]
    some += g * g
    if not isinstance(at, slice):
        squares[at] = some
    g *= RATE
    g /= np.sqrt(some, out=None if isinstance(at, slice) else some)
    w[at] -= g


def start_squares(w: Weights) -> Weights:
    return {k: np.full_like(x, FIRST_SQUARE) for k, x in w.items()}


def train(w: Weights, documents: Iterable[np.ndarray], v_end: int, squares: Weights) -> int:
    """One pass of truncated backpropagation over the documents; changes the weights in place and returns the number of tokens."""
    state, last, tokens, n = np.zeros((HIDDEN, LANES), np.float32), np.full(LANES, v_end, np.int32), 0, WINDOW
    scale = np.float32(1 / (LANES * WINDOW))  # few lanes make a small step
    for live, targets, begins, used in _windows(documents, v_end):
        width, used = len(live), used.ravel()
        ids = _inputs(targets, begins, last[live], v_end)
        states, (old, z, r, new, s) = _states(w, ids, begins, state[:, live], True)
        state[:, live], last[live] = states[-1], targets[-1]
        tokens += int(used.sum())
        gradient: dict = {}
        rows, goals = states.transpose(0, 2, 1).reshape(-1, HIDDEN), targets.ravel()
        if used.all():
            _, back = output_log_probability(w, rows, goals, v_end, gradient)
        else:
            back = np.zeros((n * width, HIDDEN), np.float32)
            _, back[used] = output_log_probability(w, rows[used], goals[used], v_end, gradient)
        back = np.ascontiguousarray(back.reshape(n, width, HIDDEN).transpose(0, 2, 1))
        # the gradients by the gates are these times the gradient by the state, which is all that goes from step to step
        by_state = np.empty((n, 3, HIDDEN, width), np.float32)
        by_new = (1 - z) * (1 - new * new)
        by_state[:, 0] = (old - new) * z * (1 - z)
        by_state[:, 1] = by_new * s * r * (1 - r)
        by_state[:, 2] = by_new * r
        some, stays = begins.any(axis=1).tolist(), (~begins).astype(np.float32)
        carried, outer = np.zeros((HIDDEN, width), np.float32), by_state.reshape(n, 3 * HIDDEN, width)
        for t in range(n - 1, -1, -1):
            d = back[t]
            d += carried
            by_state[t] *= d
            np.dot(w["state"], outer[t], out=carried)
            carried += d * z[t]
            if some[t]:
                carried *= stays[t]
        gradient["state"] = np.matmul(old, outer.transpose(0, 2, 1)).sum(axis=0)
        by_new *= back
        by_state[:, 2] = by_new
        inner = outer.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
        gradient["bias"] = inner.sum(axis=0)
        ids = ids.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
        _update(w["input"], squares["input"], _sums(inner[order], first) * scale, ids[first])
        touched = gradient.pop("touched")
        _update(w["word"], squares["word"], gradient.pop("word") * scale, touched)
        for k, g in gradient.items():
            _update(w[k], squares[k], g * scale)
    return tokens


def score(w: Weights, documents: list[np.ndarray], v_end: int) -> np.ndarray:
    """Natural log-likelihood of each document under the network (a word outside the vocabulary as its class)."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    targets, owner, begins, loads = _lanes(documents, v_end, min(SCORE_LANES, len(documents)))
    h, last = np.zeros((HIDDEN, targets.shape[1]), np.float32), np.full(targets.shape[1], v_end, np.int32)
    for at in range(0, len(targets), SCORE_WINDOW):
        window = slice(at, at + SCORE_WINDOW), slice(0, int(np.searchsorted(-loads, -at, side="left")))  # lanes longer than that
        goals, first, width = targets[window], begins[window], window[1].stop
        states, _ = _states(w, _inputs(goals, first, last[:width], v_end), first, h[:, :width])
        h, last = states[-1], goals[-1]
        used = np.flatnonzero(owner[window].ravel() >= 0)
        rows = states.transpose(0, 2, 1).reshape(-1, HIDDEN)
        logs, _ = output_log_probability(w, rows if len(used) == len(rows) else rows[used], goals.ravel()[used], v_end)
        out += np.bincount(owner[window].ravel()[used], logs, len(documents))
    return out


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def _distinct(hashes: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by bucket, then by value, and the place of each hash among them."""
    coded = pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes])).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order = np.lexsort((words, words % np.uint64(buckets)))
    places = np.empty(len(words), np.int32)
    places[order] = np.arange(len(words), dtype=np.int32)
    return words[order], places[coded.indices.to_numpy()]


def _count(buckets: int):
    """Chunks -> their distinct words with the number of times in training documents, by bucket."""

    def run(batches):
        for chunk, held in text_chunks(batches, CHUNK):
            every = [hashes for batch in held for hashes, _, _ in hash_words(text_bytes(batch.column("text")), NOT_SPACE)]
            learned = ~np.concatenate([batch.column("held_out").to_numpy(zero_copy_only=False) for batch in held]).astype(bool)
            words, places = _distinct(every, buckets)
            counts = np.bincount(places[np.repeat(learned, [len(h) for h in every])], minlength=len(words))
            cuts = np.searchsorted(words % np.uint64(buckets), np.arange(buckets + 1))
            rows = [(b, chunk, _pack(np.concatenate((words[x:y].view(np.int64), counts[x:y])))) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "payload"])

    return run


def _sum_counts(vocabulary: int | None, buckets: int):
    """Blocks of a bucket -> the summed counts for each block; and, as chunk -1, the bucket's totals and most frequent words."""

    def run(batches):
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for b, chunk, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "payload"))):
                blocks.setdefault(b, []).append((chunk, payload))
        for b, some in blocks.items():
            parts = [np.frombuffer(zstandard.decompress(p), np.int64).reshape(2, -1) for _, p in some]
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, inverse, np.concatenate([p[1] for p in parts]))
            ends = np.cumsum([p.shape[1] for p in parts])
            kind = "<u4" if total.max() < 1 << 32 else "<i8"
            answers = [kind.encode() + _pack(total[inverse[e - p.shape[1] : e]].astype(kind)) for p, e in zip(parts, ends)]
            best = np.lexsort((words, -total))[: vocabulary or 2 * vocabulary_size(buckets * len(words))]  # a bucket is a sample by hash: at least the whole vocabulary
            best = best[total[best] > 0]
            summary = np.concatenate(([int((total > 0).sum()), int(total.sum())], np.stack((words[best], total[best]), axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([b] * (len(some) + 1), pa.int32()), pa.array([c for c, _ in some] + [-1], pa.int64()), pa.array([*answers, _pack(summary)], pa.binary())], names=["bucket", "chunk", "payload"])

    return run


def _summaries(kind: str, least: int = 0):
    """Of the buckets' summaries: their totals; how many of their words have a count of 1, 2 to 3, 4 to 7, ..; or the words with `least` or more."""

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                numbers = np.frombuffer(zstandard.decompress(payload), np.int64)
                pairs = numbers[2:].reshape(-1, 2)
                if kind == "totals":
                    pairs = numbers[None, :2]
                elif kind == "levels":
                    pairs = np.stack(np.unique(np.frexp(pairs[:, 1].astype(np.float64))[1] - 1, return_counts=True), axis=1).astype(np.int64)
                else:
                    pairs = pairs[pairs[:, 1] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _least_count(levels: list[tuple[int, int]], size: int) -> int:
    """The largest power of two that at least `size` words reach (1 if there are fewer words)."""
    total = 0
    for level, n in sorted(levels, reverse=True):
        total += n
        if total >= size:
            return 1 << level
    return 1


def _train_part(shared, v: Vocabulary):
    """Documents of a partition -> weights trained on them and their step sizes, times their tokens."""

    def run(batches):
        w, squares = ({k: x.copy() for k, x in some.items()} for some in shared.value)

        def documents():
            for _, held in text_chunks(batches, CHUNK // 4):
                some = [np.append(v.ids(h), v.end).astype(np.int32) for batch in held for h, _, _ in hash_words(text_bytes(batch.column("text")), NOT_SPACE)]
                yield from sorted(some, key=lambda d: -len(d) if len(d) > LONG else 0)

        tokens = train(w, documents(), v.end, squares)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([_flat(w, squares, tokens)], pa.binary())], names=["tokens", "weights"])

    return run


def _flat(w: Weights, squares: Weights, times: int) -> bytes:
    return (np.concatenate([x.ravel() for some in (w, squares) for x in some.values()]).astype(np.float64) * times).tobytes()


def _add_weights(batches):
    total, tokens = None, 0
    for batch in batches:
        for n, weights in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist()):
            total = np.frombuffer(weights) + (0 if total is None else total)
            tokens += n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "weights"])


def fit(parts: list[DataFrame], v: Vocabulary) -> Weights:
    """Averaged weights after a round over each of the parts (column text)."""
    w = start_weights(v)
    squares = start_squares(w)
    for documents in parts:
        shared = documents.sparkSession.sparkContext.broadcast((w, squares))
        trained = documents.mapInArrow(_train_part(shared, v), "tokens long, weights binary")
        added = trained.repartition(AVERAGERS).mapInArrow(_add_weights, trained.schema)
        sums = added.repartition(1).mapInArrow(_add_weights, trained.schema).first()  # of 16 rows at most
        if sums:
            mean, at = np.frombuffer(sums.weights) / sums.tokens, 0
            w, squares = dict(w), dict(squares)
            for some in (w, squares):
                for k, x in some.items():
                    some[k] = mean[at : at + x.size].reshape(x.shape).astype(np.float32)
                    at += x.size
    return w


def _score_chunk(buckets: int, v: Vocabulary, shared, arrow: pa.Schema):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        batches = unpacked_documents(documents)
        hashes = [h for batch in batches for h, _, _ in hash_words(text_bytes(batch.column("text")), NOT_SPACE)]
        words, places = _distinct(hashes, buckets)
        counts = [np.zeros(0, np.int64)]
        for _, payload in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist())):
            counts.append(np.frombuffer(zstandard.decompress(payload[3:]), payload[:3].decode()).astype(np.int64))
        counts = np.concatenate(counts)
        if len(counts) != len(words):
            raise RuntimeError("a second reading of the documents gave other rows; pass stored=True")
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        c, ids = np.split(counts[places], cuts), np.split(v.ids(words)[places], cuts)
        base_norm = np.log10(v.total + v.distinct + 1)
        logs = np.split(np.log10(counts + 1.0)[places], cuts)
        base = [x.sum() + np.log10(v.ends + 1.0) - (len(x) + 1) * base_norm for x in logs]
        others = [x[i == v.other].sum() - (i == v.other).sum() * np.log10(v.other_norm) for x, i in zip(logs, ids)]
        model = score(shared.value, [np.append(i, v.end).astype(np.int32) for i in ids], v.end) / np.log(10) + np.array(others, float)
        rows = pa.Table.from_batches(batches)
        return pa.Table.from_arrays([rows.column("id"), rows.column("held_out"), pa.array([len(x) + 1 for x in c], pa.int64()), pa.array([int((x > 0).sum()) + (v.ends > 0) for x in c], pa.int64()),
                                     pa.array([v.total] * len(c), pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())], schema=arrow)

    return run


def vocabulary_size(distinct: int) -> int:
    """Words that the network tells apart: 256 times the fifth root of the number of distinct words (3,300 of 369,000, 16,000 of a billion)."""
    return max(LEAST_VOCABULARY, int(256 * distinct**0.2))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, vocabulary: int | None = None, rounds: int = 1, stored: bool = False) -> DataFrame:
    """One row per document: the id, `held_out` (crc32 of the id as text, modulo `folds`, is `held_fold`), `n_tokens`, `n_known`, `train_tokens`, `base_score` (smoothed unigram) and `score`
    (log10 probability of the text under the model)."""
    spark = docs.sparkSession
    crc = crc_column(id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (crc % folds == held_fold).alias("held_out"), (F.floor(crc / folds) % rounds).alias("round"))
    if stored:
        rows = checkpointed(rows, "documents")
    scored = rows.select("id", "text", "held_out")
    learned = rows.filter("not held_out")
    n_learned = learned.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-n_learned // DOCUMENTS_PER_BUCKET))
    counted = scored.select("text", "held_out").mapInArrow(_count(buckets), "bucket int, chunk long, payload binary")
    answers = checkpointed(counted.repartition(F.col("bucket")).mapInArrow(_sum_counts(vocabulary, buckets), counted.schema), "counts")
    summaries = answers.filter("chunk = -1").select("payload")
    totals = summaries.mapInArrow(_summaries("totals"), "a long, b long").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("b"), F.lit(0)).alias("total")).first()
    size = vocabulary or vocabulary_size(totals["distinct"])
    levels = summaries.mapInArrow(_summaries("levels"), "a long, b long").groupBy("a").agg(F.sum("b").alias("b")).collect()  # 63 rows at most
    least = _least_count([(r.a, r.b) for r in levels], size)
    words = summaries.mapInArrow(_summaries("words", least), "a long, b long").orderBy(F.desc("b"), "a").limit(size).collect()
    v = Vocabulary([(r.a, r.b) for r in words], n_learned, totals.total, totals["distinct"])
    shared = spark.sparkContext.broadcast(fit([learned.filter(F.col("round") == r).select("text") for r in range(rounds)], v))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = pa.schema([("id", _arrow_type(rows, "id")), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    packed = scored.mapInArrow(packed_documents(CHUNK), "chunk long, part int, payload binary")
    found = packed.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(_score_chunk(buckets, v, shared, arrow), schema)
    return found.withColumnRenamed("id", id_col)


def _arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)
