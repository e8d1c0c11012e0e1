"""Checks on chunks of sound (sources.wav.chunks). Each looks a bounded way around a sample, so it runs on a chunk and its margin, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedline.operators import seq

#: Fixed values of the dropout check: least level on both sides (dB), seconds of it, zeros at 44.1 kHz, longest hole in seconds.
DROPOUT = {"level_db": -45.0, "side_s": 0.005, "zeros_44k": 10, "longest_s": 0.0334}
#: Fixed values of the invalid-sample report: a new stretch after so many seconds; stretches a file, the rest joined with the last.
INVALID = {"gap_s": 1.0, "most": 20}
#: Lengths in headers that were never finished.
UNFINISHED = [0xFFFFFFFF, 0x7FFFFFFF]
#: Fixed values of what a file must be for a check: least rate (Hz), rates above which its band fits, least bits, and what is told otherwise.
GATES = {"breath_rate": 16_000, "plosive_hz": 8000, "tick_hz": 16_500, "least_bits": 9}
#: The margin in seconds that dropouts needs around a chunk.
MARGIN_S = 0.05

RUNS = "file string, sample_rate int, start long, stop long"


def zero_runs(cut: DataFrame) -> DataFrame:
    """Maximal runs of exact zeros: file, sample_rate, start, stop. Runs of neighbouring chunks that touch become one, by one window a file over runs only."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            own = row.samples[row.start - row.window_start : row.core_stop - row.window_start]
            a, b = _runs(own == 0)
            yield pd.DataFrame({"file": row.file, "sample_rate": row.sample_rate, "start": a + row.start, "stop": b + row.start})

    return seq.merge_runs(cut.mapInPandas(find, RUNS), ["file", "sample_rate"], 0).drop("length")


def dropouts(cut: DataFrame) -> DataFrame:
    """Short holes of exact zeros inside sound: file, sample_rate, start, stop, silence_ms, before_db, after_db, severity.

    Whole sides must lie inside the file. Files of 8 bits or less have none. Chunks need MARGIN_S of margin at least.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            rate, x = row.sample_rate, row.samples
            side = max(1, round(DROPOUT["side_s"] * rate))
            a, b = _runs(x == 0)
            own = (a + row.window_start >= row.start) & (a + row.window_start < row.core_stop)
            inside = (a >= side) & (b + side <= len(x))
            length = (b - a >= max(1, round(DROPOUT["zeros_44k"] * rate / 44100))) & (b - a <= DROPOUT["longest_s"] * rate)
            a, b = (v[own & inside & length] for v in (a, b))
            before = np.array([_level(x[s - side : s]) for s in a])
            after = np.array([_level(x[s : s + side]) for s in b])
            loud = np.minimum(before, after) >= DROPOUT["level_db"]
            found = {"start": a + row.window_start, "stop": b + row.window_start, "before_db": before, "after_db": after}
            yield pd.DataFrame({"file": row.file, "sample_rate": rate} | {k: v[loud] for k, v in found.items()})

    holes = cut.where("bit_depth > 8").mapInPandas(find, f"{RUNS}, before_db double, after_db double")
    ms = F.round((F.col("stop") - F.col("start")) * 1000 / F.col("sample_rate"), 1)
    return holes.select("file", "sample_rate", "start", "stop", ms.alias("silence_ms"), F.round("before_db", 1).alias("before_db"), F.round("after_db", 1).alias("after_db"), F.lit(3).alias("severity"))


def invalid_stretches(cut: DataFrame) -> DataFrame:
    """Stretches of invalid samples: file, start, stop, samples. What comes after the last of INVALID["most"] is part of it."""
    bad = cut.select("file", "sample_rate", F.explode("invalid").alias("i"))
    gap = F.col("i") - F.lag("i").over(seq.within(["file"], "i")) > INVALID["gap_s"] * F.col("sample_rate")
    numbered = seq.islands(bad, ["file"], "i", gap).withColumn("island", F.least("island", F.lit(INVALID["most"] - 1)))
    return numbered.groupBy("file", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.count("*").alias("samples")).drop("island")


def file_problems(files: DataFrame, stretches: DataFrame, levels: DataFrame | None = None, least_s: float = 1.0) -> DataFrame:
    """Problems of whole files, severity 3: file, start, stop, problem. Unreadable files are listed with their error, from 0 to 0.

    A file is cut short if a whole frame or more of the data that its header claims is missing; a header that was never finished (UNFINISHED) claims
    nothing. levels (file, narration_db, see voice.narration): files of a second or more without narration are listed too.
    """
    missing = F.col("bytes_claimed") - F.col("bytes_actual") >= F.greatest(F.lit(1), F.col("block_align"))
    claims = ~F.col("bytes_claimed").isin(UNFINISHED)
    cut_short = F.when(missing & claims, F.lit("file is cut short: its audio ends before its header says it should"))
    ms = F.floor(F.col("n_samples") * 1000 / F.col("sample_rate"))
    is_short = F.col("n_samples") < least_s * F.col("sample_rate")
    short = F.when(is_short, F.format_string("file is only %d ms long", ms))
    unspoken = F.lit(None).cast("string")
    if levels is not None:
        files = files.join(levels.select("file", "narration_db"), "file", "left")
        unspoken = F.when(F.col("error").isNull() & ~is_short & F.col("narration_db").isNull(), F.lit("no narration found in the file"))
    skipped = F.when(F.col("error").isNotNull(), F.concat(F.lit("skipped: "), F.col("error")))
    texts = F.array_compact(F.array(skipped, cut_short, short, unspoken))
    end = F.coalesce("n_samples", F.lit(0)).cast("long")
    whole = files.select("file", end.alias("stop"), F.explode(texts).alias("problem"))
    whole = whole.select("file", F.when(F.col("problem").startswith("file is cut short"), F.col("stop")).otherwise(0).cast("long").alias("start"), "stop", "problem")
    n = F.col("samples")
    bad = stretches.select("file", "start", "stop", F.format_string("file contains %d invalid (NaN, Inf or out-of-range) sample%s — corrupt audio", n, F.when(n == 1, "").otherwise("s")).alias("problem"))
    return whole.unionByName(bad).withColumn("severity", F.lit(3))


def gates(files: DataFrame) -> DataFrame:
    """Which checks each readable file can have, and a note for each that it can't: file, breaths, dropouts, clip_ends, plosives, ticks, notes.

    Below 16 kHz no breaths are sought (their candidates mask no clicks then); of 8 bits or less no dropouts and chopped words, since silence is exact zeros
    there; no pops where 8 kHz and no ticks where 16.5 kHz lie beyond what the rate holds.
    """
    rate, bits = F.col("sample_rate"), F.col("bit_depth")
    breaths, deep = rate >= GATES["breath_rate"], bits >= GATES["least_bits"]
    pops, ticks = rate / 2 > GATES["plosive_hz"], (0.95 * rate / 2 > GATES["tick_hz"]) & (F.col("n_samples") >= F.floor(rate / 10))
    khz = F.regexp_replace(F.format_string("%.3f", rate / 1000), r"\.?0+$", "")
    notes = F.array_compact(F.array(
        F.when(~breaths, F.concat(F.lit("breath check skipped: "), khz, F.lit(" kHz is below 16 kHz"))),
        F.when(~deep, F.format_string("dropout and chopped-word checks skipped: %d-bit audio", bits)),
        F.when(~pops, F.concat(F.lit("plosive check skipped: "), khz, F.lit(" kHz holds too little above 500 Hz"))),
        F.when(~ticks, F.concat(F.lit("tick check skipped: "), khz, F.lit(" kHz holds nothing above 16.5 kHz"))),
    ))
    known = files.where("error is null")
    return known.select("file", breaths.alias("breaths"), deep.alias("dropouts"), deep.alias("clip_ends"), pops.alias("plosives"), ticks.alias("ticks"), notes.alias("notes"))


def _rows(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        yield from batch.itertuples(index=False)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return edges[::2], edges[1::2]


def _level(x: np.ndarray) -> float:
    return 10 * np.log10(max(np.square(x, dtype=np.float64).mean(), 1e-20))
