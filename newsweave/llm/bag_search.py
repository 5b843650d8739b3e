"""Ranked lexical search with bag deduplication: documents that are the same bag of item words are scored once.

1. The words of all items are the vocabulary.  A scan of the whole documents keeps of each its number of words and its bag: the vocabulary words it holds, with their
   counts.  Word hashes find the words, and every hit is verified on its bytes.
2. Documents, words and document frequencies are counted over all bags.
3. A class is a bag with its length norm m.  Bags meet by the hash of (bag, m) and are told apart by the whole bag.  Of a class only its k smallest ids can be in a result: any
   others are left out before the shuffle, so a group of copies of any size costs k rows a task.
4. Each class is scored once against all items, by sparse sums of whole numbers.  A task keeps the k best classes of an item, by score and smallest member; heaps
   merge the lists of the tasks.
5. The members of these classes are put in order by score and id.  A class beyond the k best has k documents before all of its own, so nothing is lost.

Items are taken in blocks of at most `block_terms` words (an item with more is a block of its own), so the size of a broadcast does not grow with their number; each block is one pass.

The score of a document is the sum over the distinct words of an item of w * (1000000000 * tf div (1000 * tf + 20 * m)), with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and
m = 50 + (50 * n * N) div L; N documents hold a word, L words are in them, n in this one.

Defined results: null texts and texts without words are no documents and match nothing; items without words have no rows; a repeated doc_id is a document of its own each time,
as is a repeated item; a document without id comes after all others of its score; a text of any length is taken whole; empty tables give an
empty result; other columns play no part."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.cells import LAST_ID, BestLists, kth_largest, merged
from newsweave.llm.common import ASCII_LOWER, LETTERS_DIGITS, hash_words, slices, text_bytes
from newsweave.session import checkpointed

BLOCK_TERMS = 200_000
SLICE = 2 << 20
CELLS = 1 << 22  # sums, and addends, that a scoring step holds at a time
LARGEST_ADDEND = 1 << 35  # w is below 32,000 for any number of documents, and the other factor below 1,000,000
EXACT_DOUBLE = 1 << 53


def item_words(items: DataFrame) -> DataFrame:
    """(item, hash, word): the distinct words of each item."""

    def words(batches):
        for batch in slices(batches, SLICE):
            texts = text_bytes(batch.column("text"))
            for item, text, (hashes, starts, ends) in zip(batch.column("item").to_pylist(), texts, hash_words(texts, LETTERS_DIGITS)):
                lowered = text.translate(ASCII_LOWER)
                found = {lowered[a:b]: h for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.view(np.int64).tolist())}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.binary())], names=["item", "hash", "word"])

    return items.mapInArrow(words, "item long, hash long, word binary")


def blocks_of(words: DataFrame, block_terms: int) -> list[DataFrame]:
    """The words dealt to blocks by the hash of their item, until a block has at most `block_terms` of them or is a single item."""
    sizes = checkpointed(words.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item_sizes")
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        found = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if found.filter((F.col("n") > block_terms) & (F.col("items") > 1)).isEmpty():
            return [words.filter(block == r.block) for r in found.orderBy("block").collect()]
        blocks *= 2


class Vocabulary:
    """The words of a block of items: sorted hashes to find them, bytes to verify them, and the items of each word."""

    def __init__(self, rows: list):
        of_word: dict[bytes, list[int]] = {}
        hashes: dict[bytes, int] = {}
        self.items = sorted({r.item for r in rows})
        place = {item: i for i, item in enumerate(self.items)}
        for r in rows:
            of_word.setdefault(bytes(r.word), []).append(place[r.item])
            hashes[bytes(r.word)] = r.hash & (1 << 64) - 1
        words = sorted(hashes, key=lambda w: (hashes[w], w))
        self.hashes = np.array([hashes[w] for w in words], np.uint64)
        self.lengths = np.array([len(w) for w in words])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True
        self.same = int(np.unique(self.hashes, return_counts=True)[1].max())  # words that share a hash: one, but for a collision
        self.counts = np.array([len(of_word[w]) for w in words])
        self.first = np.cumsum(self.counts) - self.counts
        self.of_word = np.array([i for w in words for i in of_word[w]])
        self.exact = len(rows) * LARGEST_ADDEND < EXACT_DOUBLE or int(np.bincount(self.of_word).max()) * LARGEST_ADDEND < EXACT_DOUBLE

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the given words, number of the vocabulary word) of the given words that are in the vocabulary."""
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        places, numbers = [], []
        for _ in range(self.same):
            inside = at < len(self)
            maybe, at = maybe[inside], at[inside]
            fits = (self.hashes[at] == hashes[maybe]) & (self.lengths[at] == ends[maybe] - starts[maybe])
            places.append(maybe[fits])
            numbers.append(at[fits])
            at = at + 1
        place, number = np.concatenate(places), np.concatenate(numbers)
        if not len(place):
            return place, number
        length = self.lengths[number]
        before = np.cumsum(length) - length
        step = np.arange(int(length.sum()))
        equal = data[np.repeat(starts[place] - before, length) + step] == self.bytes[np.repeat(self.starts[number] - before, length) + step]
        right = np.logical_and.reduceat(equal, before)
        return place[right], number[right]


def _bags(shared, id_type: pa.DataType):
    def run(batches):
        known: Vocabulary = shared.value
        for batch in slices(batches, SLICE):
            texts = text_bytes(batch.column("text"))
            data = np.frombuffer(b"".join(texts).translate(ASCII_LOWER), np.uint8)
            offsets = np.cumsum([0, *map(len, texts)])
            found = list(hash_words(texts, LETTERS_DIGITS))
            n = np.array([len(f[0]) for f in found])
            hashes = np.concatenate([f[0] for f in found])
            starts, ends = (np.concatenate([f[i] + at for f, at in zip(found, offsets)]) for i in (1, 2))
            place, number = known.find(data, hashes, starts, ends)
            keys, counts = np.unique(np.repeat(np.arange(len(n)), n)[place] * len(known) + number, return_counts=True)
            row, word = np.divmod(keys, len(known))
            cuts = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(word, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int32()))], names=["doc_id", "n", "words", "tf"])

    return run


def _scored(shared, weights, k: int):
    def run(batches):
        known: Vocabulary = shared.value
        w, n_items = weights.value, len(known.items)
        best = BestLists(n_items, k, np.int64, others=True)
        for batch in batches:
            words, tf, m = batch.column("words"), batch.column("tf"), batch.column("m").to_numpy()
            edges, first, number = words.offsets.to_numpy(), batch.column("first").to_numpy(), batch.column("class").to_numpy()
            word, tf = words.values.to_numpy(), tf.values.to_numpy().astype(np.int64)
            addends = np.concatenate([[0], np.cumsum(known.counts[word])])
            at = 0
            while at < len(m):
                end = int(np.searchsorted(addends[edges], addends[edges[at]] + CELLS, "right")) - 1
                end = max(at + 1, min(end, at + max(1, CELLS // n_items)))
                inside = slice(edges[at], edges[end])
                row = np.repeat(np.arange(end - at), np.diff(edges[at : end + 1]))
                value = w[word[inside]] * (1_000_000_000 * tf[inside] // (1_000 * tf[inside] + 20 * m[at:end][row]))
                counts = known.counts[word[inside]]
                step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                cell = np.repeat(row, counts) * n_items + known.of_word[np.repeat(known.first[word[inside]], counts) + step]
                if known.exact:
                    total = np.bincount(cell, np.repeat(value, counts), (end - at) * n_items).astype(np.int64)
                else:
                    total = np.zeros((end - at) * n_items, np.int64)
                    np.add.at(total, cell, np.repeat(value, counts))
                total = np.ascontiguousarray(total.reshape(-1, n_items).T)
                floor = np.maximum(best.floor, 1)
                if (best.floor <= best.lowest).any():
                    floor = np.maximum(floor, kth_largest(total, k, 1))
                item, column = np.nonzero(total >= floor[:, None])
                if len(item):
                    best.offer(item, total[item, column], first[at:end][column], number[at:end][column])
                at = end
        ids, scores, classes = best.lists()
        full = [i for i, x in enumerate(ids) if len(x)]
        whole = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({"item": pa.array([known.items[i] for i in full], pa.int64()), "ids": pa.array([ids[i] for i in full], whole), "scores": pa.array([scores[i] for i in full], whole), "others": pa.array([classes[i] for i in full], whole)})

    return run


def _ranked_block(docs: DataFrame, words: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    known = Vocabulary(words.collect())  # one block of items
    shared = spark.sparkContext.broadcast(known)
    id_type = docs.schema["doc_id"].dataType
    bags = checkpointed(docs.mapInArrow(_bags(shared, id_type), f"doc_id {id_type.simpleString()}, n long, words array<int>, tf array<int>"), "bags")
    total = bags.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not total.docs:
        return None
    holding = {r.word: r.n for r in bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per word of the block
    weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(known))], np.int64))

    norm = F.expr(f"50 + (50 * cast(n as decimal(18, 0)) * {total.docs}) div {total.words}").cast("long")
    bag = bags.filter(F.size("words") > 0).select("doc_id", "words", "tf", norm.alias("m")).withColumn("hash", F.xxhash64("words", "tf", "m"))
    members = Window.partitionBy("hash", "words", "tf", "m").orderBy(F.col("doc_id").asc_nulls_last())
    first = bag.withColumn("place", F.row_number().over(members)).filter(F.col("place") <= k)
    member = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))
    classes = first.groupBy("hash", "words", "tf", "m").agg(F.array_sort(F.collect_list(member)).alias("members"))
    smallest = F.coalesce(F.col("members")[0]["id"].cast("long"), F.lit(LAST_ID))
    classes = checkpointed(classes.select("words", "tf", "m", "members", smallest.alias("first"), F.monotonically_increasing_id().alias("class")), "classes")

    lists = classes.select("words", "tf", "m", "first", "class").mapInArrow(_scored(shared, weights, k), "item long, ids array<long>, scores array<long>, others array<long>")
    best = merged(lists, ["item"], k).select("item", F.explode(F.arrays_zip("scores", "others")).alias("hit")).select("item", F.col("hit.scores").alias("score"), F.col("hit.others").alias("class"))
    each = best.join(classes.select("class", "members"), "class").select("item", "score", F.explode("members").alias("member"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "member")
    return each.select("item", "score", F.col("member.id").alias("doc_id"), F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: the item's id, rank (from 1), the document's id, score."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = checkpointed(items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    words = checkpointed(item_words(asked.select("item", "text")), "item_words")
    found = [r for r in (_ranked_block(texts, block, k) for block in blocks_of(words, block_terms)) if r is not None]
    schema = f"item long, score long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, rank int"
    ranked = docs.sparkSession.createDataFrame([], schema)
    for block in found:
        ranked = ranked.unionByName(block)
    return ranked.join(asked.select("item", "id"), "item").select(F.col("id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
