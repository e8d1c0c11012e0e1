"""Lines that many documents share, found by probing a sharded minimal perfect hash over the distinct lines."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import bounds, groups_in_order, stored

LEAST_DOCUMENTS = 3
LEAST_LENGTH = 20
BLANKS = b" \t\n\r\x0b\x0c"
#: Distinct lines of a shard; its arrays take about 18 bytes a line.
SHARD_LINES = 250_000
#: Lines that one task looks up in a shard.
PROBES = 500_000
#: Bits of a level of the hash for each line that is left to it.
SPARE = 2
#: The document of all rows without id.
NOBODY = -(1 << 63)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def long_keys(text: bytes | None, least: int = LEAST_LENGTH) -> tuple[list[int], list[bytes]]:
    """Numbers and keys of the lines of a text (UTF-8) whose keys have so many code points: blanks stripped at both ends, A to Z lower-cased."""
    at, keys = [], []
    for i, line in enumerate((text or b"").lower().split(b"\n")):  # lower() of bytes changes A to Z only
        key = line.strip(BLANKS)
        if len(key) >= least and (len(key) >= 4 * least or key.isascii() or sum((b & 0xC0) != 0x80 for b in key) >= least):
            at.append(i)
            keys.append(key)
    return at, keys


def line_hashes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, text_hash, at, hi, lo): a row for each line long enough, with the 128-bit hash of its key."""

    def run(batches):
        for batch in batches:
            row, at, digests = [], [], []
            for k, value in enumerate(batch.column("text").to_pylist()):
                found, keys = long_keys(value, least)
                row += [k] * len(found)
                at += found
                digests += map(xxhash.xxh3_128_digest, keys)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            held = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(held), batch.column("text_hash").take(held), pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(np.ascontiguousarray(halves[:, 0]))],
                ["doc", "text_hash", "at", "hi", "lo"],
            )

    rows = docs.select(document(key), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, text_hash long, at int, hi long, lo long")


def document(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NOBODY)).alias("doc")


def _bit(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key in a level of so many bits."""
    x = hi ^ (lo + np.uint64(_STEP * (level + 1) % (1 << 64)))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def perfect_hash(hi: np.ndarray, lo: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """A minimal perfect hash of distinct 128-bit keys: levels of (size, words of 64 bits, rank before each word).

    On each level the keys that have a place to themselves take it, and the others go on to the next level, until none is left. A key's number is the
    rank of its bit among all bits of all levels. About 3.7 bits a key, with the ranks 7.4.
    """
    levels, before = [], 0
    while len(hi):
        size = max(64, SPARE * len(hi))
        at = _bit(hi, lo, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8")
        count = np.bitwise_count(words).astype(np.int64)
        levels.append((size, words, before + np.cumsum(count) - count))
        before += int(count.sum())
        rest = ~alone[at.astype(np.int64)]
        hi, lo = hi[rest], lo[rest]
    return levels


def numbers(levels: list, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Each key's number in a perfect hash; for keys that weren't in it some number, or -1."""
    out = np.full(len(hi), -1, np.int64)
    open_ = np.arange(len(hi))
    for level, (size, words, before) in enumerate(levels):
        at = _bit(hi[open_], lo[open_], level, size)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        here = (words[word] >> bit) & np.uint64(1) == 1
        under = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
        out[open_[here]] = before[word[here]] + np.bitwise_count(under)
        open_ = open_[~here]
        if not len(open_):
            break
    return out


def _arrays(batches):
    """One row a shard: its perfect hash, and by a line's number the fingerprint, the count of documents (up to 65,535) and the greatest document."""
    for table in groups_in_order(batches, "shard"):
        shard, hi, lo, count, last = (table.column(c).to_numpy() for c in ("shard", "hi", "lo", "documents", "last"))
        edges = bounds(shard)
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            u, v = hi[a:b].view(np.uint64), lo[a:b].view(np.uint64)
            levels = perfect_hash(u, v)
            order = np.argsort(numbers(levels, u, v))
            packed = (pickle.dumps(levels), lo[a:b][order].astype("<i8").tobytes(), np.minimum(count[a:b][order], 65_535).astype("<u2").tobytes(), last[a:b][order].astype("<i8").tobytes())
            out.append((int(shard[a]), *packed))
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "levels", "fingerprints", "counts", "last"])


def build_index(spark: SparkSession, lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The stored shards of an index over all distinct lines of line_hashes, and their number.

    A line's documents are counted by two aggregations, first by line and document, so a line that very many documents hold is
    summed where it lies before anything meets.
    """
    each = lines.groupBy("hi", "lo", "doc").agg(F.lit(1).alias("one"))
    distinct = stored(spark, each.groupBy("hi", "lo").agg(F.count("*").alias("documents"), F.max("doc").alias("last")), "distinct-lines")
    shards = max(1, -(-distinct.count() // shard_lines))
    rows = distinct.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("long")).repartition("shard").sortWithinPartitions("shard")
    return stored(spark, rows.mapInArrow(_arrays, "shard long, levels binary, fingerprints binary, counts binary, last binary"), "line-index"), shards


def _probe(least: int):
    """Of the lines that meet the arrays of their shard: those to drop."""

    def run(batches):
        held = arrays = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, part, first = (batch.column(c).to_numpy() for c in ("shard", "part", "first"))
            doc, hash_, at, hi, lo = (batch.column(c).fill_null(0).to_numpy() for c in ("doc", "text_hash", "at", "hi", "lo"))
            edges = bounds(shard, part)
            gone = np.zeros(batch.num_rows, bool)
            for a, b in zip(edges[:-1], edges[1:]):
                if first[a] == 0:  # the arrays lead their lines
                    held = (shard[a], part[a])
                    packed = [batch.column(c)[int(a)].as_py() for c in ("levels", "fingerprints", "counts", "last")]
                    arrays = (pickle.loads(packed[0]), np.frombuffer(packed[1], "<i8"), np.frombuffer(packed[2], "<u2"), np.frombuffer(packed[3], "<i8"))
                    a += 1
                if a == b:
                    continue
                if held != (shard[a], part[a]):
                    raise ValueError(f"no arrays for shard {shard[a]}")
                levels, fingerprints, counts, last = arrays
                n = numbers(levels, hi[a:b].view(np.uint64), lo[a:b].view(np.uint64))
                known = (n >= 0) & (fingerprints[n] == lo[a:b])
                gone[a:b] = known & (counts[n] >= least) & (last[n] != doc[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(hash_[gone]), pa.array(at[gone])], ["doc", "text_hash", "at"])

    return run


def dropped(spark: SparkSession, lines: DataFrame, index: DataFrame, shards: int, least: int = LEAST_DOCUMENTS, probes: int = PROBES) -> DataFrame:
    """(doc, text_hash, gone): numbers of the lines of line_hashes to drop, of documents that have any.

    Lines go to the shard that may know them, in as many parts a shard as it has lines for, so a line that a third of all documents hold is looked up by many tasks.
    Each part gets a copy of the shard's arrays first. No text is moved, and no line meets another.
    """
    placed = lines.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("long"))
    parts = stored(spark, placed.groupBy("shard").agg(F.ceil(F.count("*") / probes).cast("long").alias("parts")), "parts")  # a row a shard
    leads = index.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("first"), "levels", "fingerprints", "counts", "last")
    asked = placed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc", "text_hash", "at"), "parts").alias("part"), F.lit(1).alias("first"), "doc", "text_hash", "at", "hi", "lo")
    both = leads.unionByName(asked, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "first")
    gone = both.mapInArrow(_probe(least), "doc long, text_hash long, at int")
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("at").alias("gone"))  # as long as one document at most


def _without(batches):
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            every = (text or b"").split(b"\n")
            out = set(gone or ())
            n_lines.append(len(every))
            n_dropped.append(len(out))
            kept.append(b"\n".join(line for i, line in enumerate(every) if i not in out) if out else text or b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(
    spark: SparkSession, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH, key: str = "doc_id", text: str = "text",
    shard_lines: int = SHARD_LINES, probes: int = PROBES,
) -> DataFrame:
    """Every document without the lines that it shares: doc_id, n_lines (before), n_dropped, text (the lines that stay, joined by newlines).

    Texts are split at newlines; a null or empty text is one empty line. A line's key is the line without blanks (space, tab, newline, return, vertical tab, form feed) at both ends and with A
    to Z lower-cased. Keys of least_length code points and more that stand in least_documents documents or more are dropped everywhere but in the greatest doc_id that
    holds them, which keeps all its lines with that key.

    Lines travel as 128-bit hashes: half of one is the fingerprint that the arrays check. An id is one document, however many rows it has; rows without id are together one
    document, below all others. Repeated rows give repeated results. An empty table: no rows. Other columns aren't read.
    """
    if not 1 <= least_documents <= 65_535:
        raise ValueError("least_documents must be 1 to 65535")
    lines = stored(spark, line_hashes(docs, key, text, least_length), "lines")
    index, shards = build_index(spark, lines, shard_lines)
    gone = dropped(spark, lines, index, shards, least_documents, probes)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), document(key), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(gone, ["doc", "text_hash"], "left").select("doc_id", "text", "gone")
    out = rows.mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, kept binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"))
