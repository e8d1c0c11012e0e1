"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reedline.llm.common import WORD, small_batches, tidy

#: A seed of so many words is enough to align; of shorter ones two, unless the item is no longer than one.
SEED_WORDS = 3
#: A seed is rare: at most so many times as frequent in the corpus as the median n-gram of its item.
RARE_TIMES = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score, as a part of the score of a perfect copy of the whole item.
THRESHOLD = 0.5
#: Items of so many words have single words as seeds too.
SHORT_WORDS = 8
#: A part of a long item counts by itself from the score of so many words in a row on.
PASSAGE_WORDS = 50
#: Meetings of seeds of a text that are looked at together.
HITS = 1 << 20
#: Items of one block: what is broadcast at once has at most so many words.
BLOCK_WORDS = 2_000_000


@dataclass
class Items:
    """A block of test items: words as numbers, and for each seed length the seeds as sorted keys with the places they stand at."""

    words: dict[str, int]
    ids: list
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> keys (sorted, one a place), item, place

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in WORD.findall(text.lower())] if text else [], np.int64)

    def keys(self, numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text whose n-gram is made of words of the items, and their keys."""
        count = len(numbers) - size + 1
        if count < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        full = np.ones(count, bool)
        for k in range(size):
            full &= numbers[k : k + count] > 0
        at = np.flatnonzero(full)
        keys = np.zeros(len(at), np.int64)
        for k in range(size):
            keys = keys * (len(self.words) + 1) + numbers[at + k]
        return at, keys


def _items(rows, every_word: bool = False) -> Items:
    """A block of items; every_word: with all single words as seeds."""
    words: dict[str, int] = {}
    ids, tokens = [], []
    for item_id, found in rows:
        ids.append(item_id)
        tokens.append(np.array([words.setdefault(w, len(words) + 1) for w in found], np.int64))
    block = Items(words, ids, tokens, {})
    for size in range(1, SEED_WORDS + 1):
        # single words for short items only, pairs and runs of SEED_WORDS for all
        some = [(i, *block.keys(t, size)) for i, t in enumerate(tokens) if size > 1 or every_word or len(t) <= SHORT_WORDS]
        keys = np.concatenate([f[2] for f in some] or [[]]).astype(np.int64)
        place = np.concatenate([f[1] for f in some] or [[]]).astype(np.int64)
        item = np.repeat([f[0] for f in some], [len(f[1]) for f in some]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        block.seeds[size] = keys[order], item[order], place[order]
    return block


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_words: int = 1, every_word: bool = False):
    """The test items of least_words or more in blocks of bounded size, read one partition at a time."""
    rows, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = WORD.findall(r["text"].lower())
        if len(words) < max(1, least_words):
            continue
        if rows and size + len(words) > block_words:
            yield _items(rows, every_word)
            rows, size = [], 0
        rows.append((r["item_id"], words))
        size += len(words)
    if rows:
        yield _items(rows, every_word)


def seed_counts(spark: SparkSession, docs: DataFrame, block: Items) -> dict[int, np.ndarray]:
    """In how many documents each distinct seed occurs, over all documents, by seed length."""
    sent = spark.sparkContext.broadcast(block)
    distinct = {size: np.unique(seeds[0]) for size, seeds in block.seeds.items()}
    keys_of = spark.sparkContext.broadcast(distinct)

    def run(batches):
        items, known = sent.value, keys_of.value
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in known.items() if len(keys)}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                numbers = items.numbers(text)
                for size, sums in counts.items():
                    keys = np.unique(items.keys(numbers, size)[1])
                    at = np.minimum(np.searchsorted(known[size], keys), len(sums) - 1)
                    sums[at[known[size][at] == keys]] += 1
        for size, sums in counts.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(sums[at])], ["size", "seed", "docs"])

    # one row a distinct seed of a block, whose words are bounded
    sums = docs.select("text").mapInArrow(tidy(run), "size long, seed long, docs long").groupBy("size", "seed").agg(F.sum("docs").alias("docs")).toArrow()
    size, seed, n = (sums.column(c).to_numpy() for c in ("size", "seed", "docs"))
    out = {k: np.zeros(len(keys), np.int64) for k, keys in distinct.items()}
    for k, found in out.items():
        found[seed[size == k]] = n[size == k]
    return out


def rare_seeds(block: Items, docs_with: dict[int, np.ndarray], times: int = RARE_TIMES) -> Items:
    """The block with those seeds only that are rare beside the other n-grams of their item.

    The measure is relative, so an item that leaked into very many documents keeps its seeds; what goes are its common phrases.
    """
    rare = {}
    for size, (keys, item, place) in block.seeds.items():
        count = docs_with[size][np.searchsorted(np.unique(keys), keys)]
        order = np.lexsort((count, item))
        edges = np.searchsorted(item[order], np.arange(len(block.ids) + 1))
        half = (edges[:-1] + edges[1:]) // 2
        middle = np.where(edges[1:] > edges[:-1], np.append(count[order], 0)[half], 0)
        keep = count <= times * np.maximum(1, middle[item])
        rare[size] = keys[keep], item[keep], place[keep]
    return Items(block.words, block.ids, block.tokens, rare)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of two runs of word numbers, and where it ends in the window.

    0 in the window is a word that no item has. One row of the table at a time; a gap along the row is a running maximum.
    """
    steps = -GAP * np.arange(len(window) + 1)
    above = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros(len(window) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _least_score(words: int, threshold: float) -> float:
    """The least score that an item of so many words is found with: the threshold, but three words at least (or the whole item), PASSAGE_WORDS at most."""
    if words < SEED_WORDS:
        return MATCH * words
    return min(max(threshold * MATCH * words, MATCH * SEED_WORDS), MATCH * PASSAGE_WORDS)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping spans of one item made one. Columns: item, from, to, whether its seeds are enough, least and greatest place of them in the item."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    far = int(spans[:, 2].max()) + 2
    reach = np.maximum.accumulate(spans[:, 0] * far + spans[:, 2])
    first = np.flatnonzero(np.append(True, spans[1:, 0] * far + spans[1:, 1] > reach[:-1]))
    out = spans[first].copy()
    out[:, 2] = np.maximum.reduceat(spans[:, 2], first)
    out[:, 3] = np.maximum.reduceat(spans[:, 3], first)
    out[:, 4] = np.minimum.reduceat(spans[:, 4], first)
    out[:, 5] = np.maximum.reduceat(spans[:, 5], first)
    return out


def _spans(items: Items, numbers: np.ndarray, exact: bool) -> np.ndarray:
    """The stretches of a text around the seeds that it shares with items (see _merged), with room for words put in or left out."""
    lengths = None
    out = np.empty((0, 6), np.int64)
    for size, (known, item, place) in items.seeds.items():
        at, keys = items.keys(numbers, size)
        first, last = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
        met = np.flatnonzero(last > first)
        if not len(met):  # as in most texts
            continue
        if lengths is None:
            lengths = np.array([len(t) for t in items.tokens], np.int64)
        n = (last - first)[met]
        cut = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS), "right")
        for a, b in zip(np.append(0, cut), np.append(cut, len(met))):
            h, count = met[a:b], n[a:b]
            if not len(h):
                continue
            k = np.repeat(first[h] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            words = lengths[item[k]]
            low = np.repeat(at[h], count) - place[k] - words // 2
            enough = np.full(len(k), True) if exact or size == SEED_WORDS else words <= size
            found = np.stack([item[k], np.maximum(0, low), np.minimum(len(numbers), low + 2 * words + 1), enough, place[k], place[k]], axis=1)
            out = _merged(np.concatenate([out, found]))
    return out


def _matches(items: Items, text: str | None, threshold: float, exact: bool = False):
    """(item number, score part, first word, last word + 1) of the best alignment of each item that has one."""
    numbers = items.numbers(text)
    spans: dict[int, list[tuple]] = {}
    for item, a, b, enough, low, high in _spans(items, numbers, exact).tolist():
        spans.setdefault(item, []).append((a, b, enough or low != high))  # two different seeds of the item are enough too
    for i, found in spans.items():
        item, whole = items.tokens[i], MATCH * len(items.tokens[i])
        best, least = (0.0, 0, 0), _least_score(len(item), threshold)
        for a, b, enough in found:
            if not enough:
                continue
            score, end = align(item, numbers[a:b])
            if score >= least and score / whole > best[0]:
                back, start = align(item[::-1], numbers[a : a + end][::-1])
                best = (score / whole, a + end - start, a + end)
        if best[0]:
            yield i, *best


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, least_words: int = 1, exact: bool = False
) -> DataFrame:
    """Documents that hold a test item, whole or edited: doc_id, item_id, score, first_word, last_word; one row a pair.

    Words are lower-cased runs of letters, digits and underscores. The n-grams of the items, less those common beside
    their item's others over all documents, are seeds: of three words, of which one is enough, and pairs (single words too for items of SHORT_WORDS or less), of which two are needed. Where a document has
    them, the stretch around is aligned with the item by Smith-Waterman over words (match 2, other word -1, gap -1). score is the best
    local score as a part of a perfect copy's. A pair of document and item is found when that part reaches `threshold` and three words' score, or the score
    of PASSAGE_WORDS words, so that passages of long items count by themselves; an item of one or two words needs its exact run (with
    least_words, shorter items than that are passed over). The words first_word to last_word (0 on) are the aligned stretch.

    Items are read in blocks of at most block_words words (or one item); a block is broadcast and sought in all documents, so no text is shuffled and
    the work follows the documents. Null texts and items without words match nothing; rows without item_id are passed over; item_id may be of any
    type that sorts. A longer item with no two words left side by side isn't found, unless exact: then every word of every item is a seed, common ones too, and
    one is enough, so that each document is aligned with each item wherever they share a word; that costs as much more as words repeat. Repeated rows of docs give a row each. Other columns aren't read.
    """
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of_item = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {of_item.simpleString()}, score double, first_word int, last_word int"
    types = (pa.int64(), to_arrow_type(of_item), pa.float64(), pa.int32(), pa.int32())
    out = None
    for block in item_blocks(benchmark, block_words, least_words, exact):
        sent = spark.sparkContext.broadcast(block if exact else rare_seeds(block, seed_counts(spark, docs, block)))

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                found = [(d, items.ids[i], *rest) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, *rest in _matches(items, t, threshold, exact)]
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        found = rows.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
