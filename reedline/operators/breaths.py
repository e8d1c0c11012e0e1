"""Breaths: grading of candidates, mouth clicks, confirmation by a network's frames, and breaths that are cut off into silence.

Candidates are rows file, start, stop, loudness_db, flagged (whether their finder heard a click). Frames are rows file, frame, p, every 10 ms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedline.operators import defects, joins, kernels, seq, voice
from reedline.operators.sound import zero_runs

#: Loudness from which a breath has severity 1, 2 and 3; where its click is sought, how sharp, loud and far from the word it must be.
LOUD_DB = [-31.6, -26.4, -22.5]
CLICK = {"before_s": 0.1, "after_s": 0.04, "rise_db": 8.0, "word_db": -25.0, "silence_ms": 100, "harsh_db": -20.0, "least_db": -40.0, "look_s": 1.5, "own_bins": 15, "rms_44k": 32}
#: Frames count from this chance, for so long in a breath.
CONFIRM = {"p": 0.5, "ms": 100}
#: A hole of zeros of this length, a breath that ends so near before it and lasts so long; a listed one so near covers it.
CUT = {"silence_s": (0.05, 0.08), "reach": 4, "frames": 5, "listed_s": 0.4, "overlap_s": 0.02}
TEXT = ["quiet breath", "noticeable breath", "loud breath", "very loud breath"]
CLICK_TEXT = {2: "small mouth-click inhale", 3: "mouth-click inhale"}
MARGIN_S = 2.0
#: Fixed value: a candidate this near the narration (dB) is speech.
SPEECH_DB = 15.0


def not_speech(candidates: DataFrame, frames: DataFrame, levels: DataFrame, network_on: bool) -> DataFrame:
    """candidates (with sample_rate) that aren't as loud as speech: those whose upper quartile of frame levels lies SPEECH_DB or less under the narration go.

    Where a network confirms breaths, it decides instead and all stay. frames: voice.speech_frames.
    """
    if network_on:
        return candidates
    hop = F.round(F.lit(voice.HOP_S) * F.col("sample_rate"))
    each = candidates.select("file", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / hop), F.floor((F.col("stop") - 1) / hop))).alias("frame"))
    upper = each.join(frames.select("file", "frame", "level_db"), ["file", "frame"]).groupBy("file", "start", "stop").agg(F.percentile("level_db", F.lit(0.75)).alias("upper"))
    loud = upper.join(levels, "file").where(F.col("upper") >= F.col("narration_db") - SPEECH_DB)
    return candidates.join(loud.select("file", "start", "stop"), ["file", "start", "stop"], "left_anti")


def confirmed(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """candidates (with sample_rate) with held_ms, how long the network hears a breath in them; those of less than 100 ms go. Frames meet breaths by number."""
    rate = F.col("sample_rate")
    first = F.round(F.col("start") * 100 / rate).cast("long")
    spans = candidates.withColumn("_a", first).withColumn("_b", F.greatest(first + 1, F.round(F.col("stop") * 100 / rate).cast("long")))
    yes = frames.where(F.col("p") >= CONFIRM["p"]).select("file", F.col("frame").alias("_f")).distinct()
    each = spans.select("file", "start", "stop", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("_f")).distinct()
    held = each.join(yes, ["file", "_f"]).groupBy("file", "start", "stop").agg((10 * F.count("*")).alias("held_ms"))
    return candidates.join(held, ["file", "start", "stop"]).where(F.col("held_ms") >= CONFIRM["ms"])


def clicks_near(cut: DataFrame, candidates: DataFrame, levels: DataFrame) -> DataFrame:
    """For each candidate of a file with narration: file, start, stop, at, rise_db, silence_ms, click_db (against the narration). Chunks need MARGIN_S."""
    held = candidates.join(levels.where("narration_db is not null"), "file").groupBy("file", "narration_db").agg(F.collect_list(F.struct("start", "stop")).alias("breaths"))

    def silence(x: np.ndarray, at: int, h: int, limit: float) -> int:
        """Milliseconds back from the click's onset at x[at] to the word, 0 if sound runs into it."""
        power = np.square(x[: len(x) // h * h]).reshape(-1, h).mean(axis=1)
        env = kernels.db(np.convolve(power, np.ones(5) / 5, "valid"))
        i = min(len(env), max(0, at // h - 3))
        quiet = np.flatnonzero(env[max(0, i - CLICK["own_bins"]) : i][::-1] < limit)
        if not len(quiet) and i:
            return 0
        i -= int(quiet[0]) if len(quiet) else 0
        low = max(0, i - int(CLICK["look_s"] * 1000))
        loud = np.flatnonzero(env[low:i] >= limit)
        return i - low - (int(loud[-1]) if len(loud) else 0)

    def find(batches):
        for row in voice.rows(batches):
            rate, x = row.sample_rate, np.asarray(row.samples, np.float64)
            own = [b for b in row.breaths if row.start <= b["start"] < row.core_stop]
            out = []
            for b in own:
                low, high = max(0, b["start"] - int(CLICK["before_s"] * rate) - row.window_start), b["start"] + int(CLICK["after_s"] * rate) - row.window_start
                rises, centres = defects.rises(x, rate, row.window_start, row.n_samples, low, high)
                if not len(rises):
                    continue
                k = int(rises.argmax())
                at = int(centres[k]) - row.window_start
                h, reach = voice.bin_size(rate), int(0.0015 * rate)
                shift = -row.window_start % h
                n = max(1, round(CLICK["rms_44k"] * rate / 44_100))
                part = np.square(x[max(0, at - reach - n) : at + reach + n])
                level = kernels.db(np.convolve(part, np.ones(n) / n, "same").max()) - row.narration_db
                ms = silence(x[shift:], at - shift, h, row.narration_db + CLICK["word_db"])
                out.append((row.file, b["start"], b["stop"], at + row.window_start, float(rises[k]), round(ms * h * 1000 / rate), float(level)))
            yield pd.DataFrame(out, columns=["file", "start", "stop", "at", "rise_db", "silence_ms", "click_db"])

    return cut.join(held, "file").mapInPandas(find, "file string, start long, stop long, at long, rise_db double, silence_ms int, click_db double")


def breaths(candidates: DataFrame, near: DataFrame) -> DataFrame:
    """Each candidate graded: file, start, stop, severity (0: informational), problem and measures. near: clicks_near.

    A breath is graded by its loudness and by its mouth click, if it has one; the worse counts, and both are told if both count.
    """
    c = CLICK
    loudness = F.round("loudness_db", 1)
    loud = sum((F.coalesce((loudness >= x).cast("int"), F.lit(0)) for x in LOUD_DB), F.lit(0))
    level = F.round("click_db", 1)
    heard = F.col("at").isNotNull() & (F.coalesce("flagged", F.lit(False)) | (F.col("rise_db") >= c["rise_db"]))
    clicks = heard & (F.col("silence_ms") >= c["silence_ms"]) & (level >= c["least_db"])
    click = F.when(clicks, F.when(level >= c["harsh_db"], 3).otherwise(2)).otherwise(0)
    rows = candidates.join(near, ["file", "start", "stop"], "left").withColumn("_loud", loud).withColumn("_click", click)
    has = F.col("_click") > 0
    told = F.when(has, F.when(F.col("_click") == 3, CLICK_TEXT[3]).otherwise(CLICK_TEXT[2]))
    said = F.when((F.col("_loud") > 0) | ~has, F.element_at(F.array(*map(F.lit, TEXT)), (F.col("_loud") + 1).cast("int")))
    return rows.select(
        "file", F.when(has, F.least("start", "at")).otherwise(F.col("start")).alias("start"), "stop", F.greatest("_loud", "_click").cast("int").alias("severity"),
        F.concat_ws("; ", told, said).alias("problem"), loudness.alias("loudness_db"), has.alias("mouth_click"),
        F.round(F.when(heard, F.col("rise_db")), 1).alias("click_rise_db"), F.when(heard, F.col("silence_ms")).alias("ms_since_word"), F.when(heard, level).alias("click_db"),
    )


def breath_cuts(cut: DataFrame, files: DataFrame, frames: DataFrame, listed: DataFrame) -> DataFrame:
    """Breaths that run into a short hole of exact zeros with sound after it, and aren't listed: file, sample_rate, start, stop, severity 0, problem, duration_ms, silence_ms."""
    low, high = CUT["silence_s"]
    size = (F.col("stop") - F.col("start")) / F.col("sample_rate")
    holes = zero_runs(cut).join(files.select("file", "n_samples"), "file").where((F.col("start") > 0) & (F.col("stop") < F.col("n_samples")) & size.between(low - 1e-9, high + 1e-9))
    holes = holes.withColumn("_hole", F.floor(F.col("start") * 100 / F.col("sample_rate")))
    w = seq.within(["file"], "frame")
    yes = seq.islands(frames.where(F.col("p") >= CONFIRM["p"]).select("file", "frame"), ["file"], "frame", F.col("frame") - F.lag("frame").over(w) > 2)
    first = yes.groupBy("file", "island").agg(F.min("frame").alias("first"))
    yes = yes.join(first, ["file", "island"]).select("file", F.col("frame").alias("_f"), "first")
    reach = holes.withColumn("_f", F.explode(F.sequence(F.col("_hole") - CUT["reach"], F.col("_hole") - 1)))
    ends = reach.join(yes, ["file", "_f"]).groupBy("file", "sample_rate", "start", "stop").agg(F.max("_f").alias("last"), F.max_by("first", "_f").alias("first"))
    found = ends.where(F.col("last") - F.col("first") + 1 >= CUT["frames"])
    start = F.col("start").cast("double")
    found = joins.with_overlap(found, listed, ["file"], start - CUT["listed_s"] * F.col("sample_rate"), start + CUT["overlap_s"] * F.col("sample_rate"), start, F.col("stop").cast("double"), "anti")
    rate = F.col("sample_rate")
    return found.select(
        "file", "sample_rate", F.floor(F.col("first") * rate / 100).alias("start"), "stop", F.lit(0).alias("severity"), F.lit("breath cut off into silence").alias("problem"),
        (10 * (F.col("last") - F.col("first") + 1)).cast("int").alias("duration_ms"), F.round((F.col("stop") - F.col("start")) * 1000 / rate, 1).alias("silence_ms"),
    )
