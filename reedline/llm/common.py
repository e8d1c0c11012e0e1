"""Helpers that the text operators share: shared tables, words and shingles."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from reedline.sources import shared
from reedline.sources.shared import fresh_path  # noqa: F401

WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows go to Python in batches of about so many bytes at most. Spark's own bound is 10,000 rows, 20 MB of usual texts, which the JVM and each worker hold several times over, idle workers too.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor owns the rows."""
    return shared.stored(df, name)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python tasks in batches of BATCH_BYTES; a bound that the session names itself is left."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def tidy(run):
    """run over batches, after which a worker gives back what the task has freed: it stays, idle, beside those of other steps."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, which else keeps pages between blocks in use
        if trim:
            trim(0)

    return tidied


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all words beyond a fixed number."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits and underscores) of a text."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words, in order; a shorter text has one run, an empty text none."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + count]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, known: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct word shingles of a whole text, ascending."""
    return np.unique(ngram_hashes(word_hashes(text, known), size))


def groups_in_order(batches, *keys: str):
    """From batches sorted by keys (integers, no nulls): tables of whole groups; a group may span batches, never tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for values in columns:
            changes[1:] |= values[1:] != values[:-1]
        if held:
            before = [held[-1].column(k)[-1].as_py() for k in keys]
            changes[0] = any(v[0] != b for v, b in zip(columns, before))
        starts = np.flatnonzero(changes)
        if not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end of the last."""
    n = len(columns[0])
    changes = np.ones(n, bool)
    if n:
        changes[1:] = False
        for values in columns:
            changes[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changes), n)
