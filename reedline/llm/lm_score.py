"""Language-model scoring by cross-entropy difference of two matched bigram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import WordHashes, bounds, groups_in_order, word_hashes

#: Smoothing. A word's chance: its count plus PRIOR_WORDS spread evenly over a vocabulary of OPEN_WORDS. A bigram's: its count plus PRIOR_PAIRS times that.
OPEN_WORDS, PRIOR_WORDS, PRIOR_PAIRS = 1_000_000, 1000.0, 2.0
#: Text bytes of a block, the documents that a task counts and scores together.
BLOCK_BYTES = 4 << 20
#: Text bytes for each range of keys, whose counts a task holds at once.
PART_BYTES = 16 << 20
#: Keys of counts: words have even keys, pairs of words odd ones. These two stand for all words and for the start of a text.
ALL, START = 0, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ONE = np.uint64(1)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * _A + b * _B
    return (mixed ^ (mixed >> np.uint64(31))) * _A | _ONE


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, all first bytes before all second ones: sorted or small numbers then compress well."""
    if x.dtype != np.uint64 or not len(x) or x.max() < 1 << 32:
        x = x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint32)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(raw: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Numbers of several packed arrays, one after another."""
    out = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for part, n in zip(raw, counts.tolist()):
        width = len(part) // n
        out[at : at + n] = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()
        at += n
    return out


class _Block:
    """The documents of one block as flat arrays: one element a word, in the order of the texts."""

    def __init__(self, rows: pa.Table, known: WordHashes):
        counted = rows.column("counted").to_numpy()
        at = np.flatnonzero(counted >= 0)
        marks = rows.column("doc_id").take(np.flatnonzero(counted < 0)).combine_chunks()
        self.ids = rows.column("doc_id").take(at).combine_chunks()
        texts = rows.column("text").take(at).to_pylist()
        words = [word_hashes(t, known) & ~_ONE for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.counted = counted[at] > 0
        self.target = self.counted & pc.is_in(self.ids, value_set=marks).to_numpy(zero_copy_only=False)
        flat = np.concatenate([*words, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(at)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty(len(flat), np.uint64)
        before[1:] = flat[:-1]
        before[self.first[self.sizes > 0]] = START
        self.words, self.word = np.unique(flat, return_inverse=True)
        self.pairs, self.pair = np.unique(_pair_keys(before, flat), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the block, their ascending order, and how often each occurs in its counted and in its target documents."""
        has_words = self.sizes > 0
        keys = np.concatenate([np.array([ALL, START], np.uint64), self.words, self.pairs])
        sums = []
        for flag in (self.counted, self.target):
            weight = flag[self.doc].astype(float)
            sums.append(
                np.concatenate(
                    [[weight.sum(), (flag & has_words).sum()], np.bincount(self.word, weight, len(self.words)), np.bincount(self.pair, weight, len(self.pairs))]
                ).astype(np.int64)
            )
        return keys, np.argsort(keys, kind="stable"), *sums

    def own(self, at: np.ndarray, kinds: int) -> np.ndarray:
        """How often each word's key occurs in its own document."""
        _, place, n = np.unique(self.doc * max(1, kinds) + at, return_inverse=True, return_counts=True)
        return n[place]

    def losses(self, total: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """Sum of the losses of each document under the model with these counts, less the document's own where flag says they are in them."""
        n_words = len(self.words)
        mine = flag[self.doc].astype(np.int64)
        word = total[2 + self.word] - mine * self.own(self.word, n_words)
        pair = total[2 + n_words + self.pair] - mine * self.own(self.pair, len(self.pairs))
        context = np.empty(len(word), np.int64)
        context[1:] = word[:-1]
        some = self.sizes > 0
        context[self.first[some]] = total[1] - flag[some]
        every = total[0] - mine * self.sizes[self.doc]
        one = (word + PRIOR_WORDS / OPEN_WORDS) / (every + PRIOR_WORDS)
        two = (pair + PRIOR_PAIRS * one) / (context + PRIOR_PAIRS)
        return np.bincount(self.doc, -np.log(two), len(self.sizes)).astype(float)


def _count(parts: int):
    """(block, part, keys, n, target): the distinct words and pairs of each block in ascending order of their keys, cut into ranges of keys."""
    limits = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)

    def run(batches):
        known = WordHashes()
        for table in groups_in_order(batches, "block"):
            block = table.column("block").to_numpy()
            edges = bounds(block)
            for a, b in zip(edges[:-1], edges[1:]):
                keys, order, *sums = _Block(table.slice(a, b - a), known).counts()
                columns = [keys[order], *(x[order] for x in sums)]
                cuts = [0, *np.searchsorted(columns[0], limits), len(keys)]
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                size = [int(cuts[p + 1] - cuts[p]) for p in some]
                packed = [pa.array([_packed(x[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block[a])), pa.array(some, pa.int32()), pa.array(size, pa.int32()), *packed], ["block", "part", "size", "keys", "n", "target"])

    return run


def _others(batches):
    """(block, part, n, target): for each key of a block how often it occurs in all other blocks. A task holds one range of keys at a time."""
    for table in groups_in_order(batches, "part"):
        part = table.column("part").to_numpy()
        edges = bounds(part)
        for a, b in zip(edges[:-1], edges[1:]):
            rows = table.slice(a, b - a)
            size = rows.column("size").to_numpy()
            at = np.unique(_unpacked(rows.column("keys").to_pylist(), size), return_inverse=True)[1]
            cuts = np.cumsum([0, *size])
            packed = []
            for name in ("n", "target"):
                n = _unpacked(rows.column(name).to_pylist(), size)
                n = np.bincount(at, n)[at].astype(np.uint64) - n
                packed.append(pa.array([_packed(n[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), pa.array(part[a:b]), pa.array(size), *packed], ["block", "part", "size", "n", "target"])


def _score(rows: pa.Table, found: pa.Table) -> pa.Table:
    """One block's documents with their losses. found: how often the block's keys occur in other blocks, by range of keys."""
    block = _Block(rows, WordHashes())
    _, order, *totals = block.counts()
    found = found.sort_by("part")
    sums = []
    for name, total, flag in zip(("n", "target"), totals, (block.counted, block.target)):
        total[order] += _unpacked(found.column(name).to_pylist(), found.column("size").to_numpy()).astype(np.int64)
        sums.append(block.losses(total, flag))
    return pa.table([block.ids, pa.array(block.sizes), pa.array(sums[1]), pa.array(sums[0])], names=["doc_id", "n_words", "loss_target", "loss_background"])


def _rows(df: DataFrame, text: Column, counted: int) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"), F.lit(counted).alias("counted"))


def cross_entropy_difference(
    spark: SparkSession, docs: DataFrame, target: DataFrame, others: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Every document with n_words, loss_target, loss_background and score = loss_target - loss_background.

    The background model counts the words and pairs of words of all docs (doc_id, text), the target model those of the docs whose
    doc_id is in target (doc_id); both share one open vocabulary. A document is scored by both models less its own words, so that a
    target document is not known by heart. others: documents that are scored too but counted in neither model. Losses are nats a
    word; a low score means text like the target's.

    Texts go, by a hash of doc_id (of the text where that is null), to blocks of about block_bytes. A block counts its distinct words and
    pairs (by 64-bit hashes), once each, so the most frequent pair costs its owner one number a block. Counts go to owners of ranges of
    keys, as packed arrays (at most one a block and range), and each block gets back what the others have of its keys and scores its documents. No table of counts is held
    whole anywhere, sent to all tasks, cut or sampled.

    A text that is null or has no word has n_words 0 and null losses and score. With no target rows the target is uniform. Repeated rows are each
    counted and scored, the other rows of the same doc_id being other documents. An empty table gives no rows; other columns aren't read. Whole texts count.
    """
    every = _rows(docs, F.col("text"), 1)
    if others is not None:
        every = every.unionByName(_rows(others, F.col("text"), 0))
    size = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = _rows(target.select("doc_id").where("doc_id is not null"), F.lit(None), -1)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = every.unionByName(marks).withColumn("block", F.pmod(place, F.lit(1 + size // block_bytes)))
    blocks = rows.repartition("block")
    counts = blocks.sortWithinPartitions("block").mapInArrow(_count(1 + size // part_bytes), "block long, part int, size int, keys binary, n binary, target binary")
    others = counts.repartition("part").sortWithinPartitions("part").mapInArrow(_others, "block long, part int, size int, n binary, target binary")
    scored = blocks.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(_score, "doc_id long, n_words long, loss_target double, loss_background double")
    mean = {m: F.when(F.col("n_words") > 0, F.col(f"loss_{m}") / F.col("n_words")) for m in ("target", "background")}
    return scored.select("doc_id", "n_words", mean["target"].alias("loss_target"), mean["background"].alias("loss_background"), (mean["target"] - mean["background"]).alias("score"))
