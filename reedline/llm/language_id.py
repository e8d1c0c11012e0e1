"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import small_batches, tidy

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: At most about this many labelled documents a language are learnt from; those with the least hash of the id.
SAMPLE_PER_LANG = 4000
#: Characters scored at once; a longer text goes on in the next piece.
PIECE = 1 << 18
#: The broadcast matrix: languages x BUCKETS float32 values. More languages than this are refused.
MAX_LANGS = 1024
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _codes(text: str | None) -> np.ndarray:
    """Lower-cased letters of a text as code points, each run of other characters as one blank, blanks at both ends."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] |= not is_letter[0]
    out = np.where(is_letter, codes, np.uint32(32))[keep]
    lead = [] if out[0] == 32 else [32]
    tail = [] if out[-1] == 32 else [32]
    return np.concatenate([np.array(lead, np.uint32), out, np.array(tail, np.uint32)])


def _grams(codes: np.ndarray, buckets: int = BUCKETS, starts: int = PIECE) -> np.ndarray:
    """Bucket of each character n-gram of a run of code points that begins at one of its first `starts`."""
    found = []
    state = np.zeros(len(codes), np.uint64)
    for size in range(1, max(SIZES) + 1):
        if len(codes) < size:
            break
        state = (state[: len(codes) - size + 1] + codes[size - 1 :].astype(np.uint64) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(31)
        if size in SIZES:
            found.append((state[:starts] >> np.uint64(20)) % np.uint64(buckets))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _pieces(codes: np.ndarray):
    """A long text in pieces that overlap by what an n-gram needs; as a piece counts those that begin in its own part, each is seen once."""
    for at in range(0, max(len(codes), 1), PIECE):
        yield codes[at : at + PIECE + max(SIZES) - 1]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # log probabilities, buckets x languages
    prior: np.ndarray


def _count(batches):
    """Counts of each language's n-grams in one partition, as sparse rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(_codes(text)):
                counts += np.bincount(_grams(piece), minlength=BUCKETS)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(spark: SparkSession, labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on labelled rows (doc_id, text, lang); only text and lang are learnt from.

    Rows without text or lang are passed over. Beyond `sample_per_lang` documents of a language, those whose hashed id and text lie under that
    language's share are taken: a bounded, repeatable sample (of rows without id, one that follows how the table is read). Counting runs in the tasks, sums in an aggregation;
    the driver gets languages x buckets numbers.
    """
    small_batches(spark)
    known = labelled.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # rows without id count by text and place, so that they aren't taken or passed over together
    place = F.xxhash64("doc_id", "text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    place = F.pmod(place, F.lit(1_000_003)) / 1_000_003
    share = F.lit(1.0)
    for r in sizes:
        if r["count"] > sample_per_lang:
            share = F.when(F.col("lang") == r["lang"], sample_per_lang / r["count"]).otherwise(share)
    sums = (
        known.where(place < share).select("text", "lang").mapInArrow(tidy(_count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros((BUCKETS, len(langs)))
    counts[sums["bucket"].to_numpy(int), sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = sums["n"]
    counts += SMOOTHING
    prior = np.log(np.array([r["count"] for r in sizes]) / sum(r["count"] for r in sizes))
    return Model(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text, scored as sparse rows of n-gram buckets times the matrix."""
    totals = np.tile(model.prior, (len(texts), 1))
    sure = np.zeros(len(texts), bool)
    owner, held, waiting = [], [], 0

    def flush():
        if not held:
            return
        at = np.cumsum([0, *map(len, held[:-1])])
        grams = np.concatenate(held)
        for k in range(len(model.langs)):
            np.add.at(totals[:, k], owner, np.add.reduceat(model.weights[:, k][grams], at, dtype=np.float64))
        owner.clear()
        held.clear()

    for i, text in enumerate(texts):
        codes = _codes(text)
        sure[i] = len(codes) > 0
        if not sure[i] or not model.langs:
            continue
        for piece in _pieces(codes):
            owner.append(i)
            held.append(_grams(piece))
            waiting += len(held[-1])
            if waiting >= PIECE:
                flush()
                waiting = 0
    flush()
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    best = totals.argmax(axis=1)
    odds = np.exp(totals - totals.max(axis=1, keepdims=True))
    score = 1.0 / odds.sum(axis=1)
    return [model.langs[b] if s else UNKNOWN for b, s in zip(best, sure)], [float(p) if s else 0.0 for p, s in zip(score, sure)]


def identify(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns `keep`, all by default) with lang_pred and score, from the text alone.

    lang_pred is a learnt language, or 'und' with score 0 where the text is null or has no letter, and for all rows when nothing
    was learnt. score is the posterior probability. Ties go to the language first in order. Whole texts are read, long ones in
    pieces. Columns of docs named lang_pred or score are replaced. An empty table gives no rows.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    # by place, not by name: docs may have any columns
    source = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], docs["text"].alias("t"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-1]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = score_texts(sent.value, part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(tidy(run), ", ".join([*([schema] if schema else []), "lang_pred string", "score double"])).toDF(*keep, "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


