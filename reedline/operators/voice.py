"""Where a sound file speaks and where it pauses: tables of 1 ms bins and of frames from chunks (sources.wav.chunks), and what follows from them.

The tables come from chunks without a shuffle; windows over them are per file. Samples are counted from 0, stops are exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.operators import kernels, quantiles, seq
from reedline.sources.shared import stored

#: Fixed values of activity: sound lies so far under the narration (dB), or over the floor; bins of the envelope; shorter sounds are clicks (bins); least pause (s);
#: black below (dB); with this share of black there is no floor; the threshold stays so far under the narration.
ACTIVITY = {"below_narration": 45.0, "above_floor": 8.0, "envelope": 5, "click_bins": 30, "pause_s": 0.25, "black_db": -120.0, "black_share": 0.05, "under_narration": 10.0}
#: A frame is speech from this autocorrelation and level on. Local speech is sought so far around (s), in so many frames at least.
SPEECH = {"voicing": 0.5, "level_db": -50.0, "around_s": 10.0, "least": 20}
#: Fixed values of the pause rules (s): head, tail and break lengths, what they may differ by, where a heading is sought, paragraphs of each rule set.
RULES = {"head": 1.0, "tail": 2.5, "break": 2.5, "end_tolerance": 0.10, "break_tolerance": 0.25, "heading_within": 20.0}
PARAGRAPHS = {"standard": (0.5, 0.8), "no-paragraph": None}
FRAME_S, HOP_S = 0.040, 0.010
PITCH_HZ = (70.0, 400.0)
MARGIN_S = 0.05
#: Bins that a window looks at in one task.
STRETCH = 120_000


def rows(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        yield from batch.itertuples(index=False)


def bin_size(rate: int) -> int:
    return max(1, round(rate / 1000))


def bins(cut: DataFrame) -> DataFrame:
    """file, sample_rate, bin, power: the mean square of each whole bin of about 1 ms."""

    def find(batches):
        for row in rows(batches):
            h = bin_size(row.sample_rate)
            first, last = -(-row.start // h), min(-(-row.core_stop // h), row.n_samples // h)
            x = np.asarray(row.samples, np.float64)[first * h - row.window_start : last * h - row.window_start]
            power = np.square(x).reshape(-1, h).mean(axis=1) if last > first else np.empty(0)
            yield pd.DataFrame({"file": row.file, "sample_rate": row.sample_rate, "bin": np.arange(first, first + len(power)), "power": power})

    return cut.mapInPandas(find, "file string, sample_rate int, bin long, power double")


def speech_frames(cut: DataFrame) -> DataFrame:
    """file, sample_rate, frame, start, level_db, voicing, zero: frames of 40 ms every 10 ms. voicing is the greatest autocorrelation at a pitch of speech."""

    def find(batches):
        for row in rows(batches):
            rate = row.sample_rate
            n, hop = round(FRAME_S * rate), round(HOP_S * rate)
            first, last = -(-row.start // hop), min(-(-row.core_stop // hop), max(0, (row.n_samples - n) // hop + 1))
            count = max(0, last - first)
            x = kernels.frames(np.asarray(row.samples, np.float64), n, hop, first * hop - row.window_start, count)
            level = kernels.db(np.square(x).mean(axis=1)) if count else np.empty(0)
            centred = x - x.mean(axis=1, keepdims=True) if count else x
            power = np.fft.rfft(centred, 2 * n, axis=1)
            ac = np.fft.irfft(np.abs(power) ** 2, axis=1)[:, :n]
            low, high = int(rate / PITCH_HZ[1]), min(n - 1, int(rate / PITCH_HZ[0]))
            # corrected for the shorter overlap at longer lags
            lags = np.arange(low, high)
            best = (ac[:, lags] / (1 - lags / n)).max(axis=1) if count and len(lags) else np.zeros(count)
            voicing = np.divide(best, ac[:, 0], out=np.zeros(count), where=ac[:, 0] > 1e-12) if count else np.empty(0)
            yield pd.DataFrame({"file": row.file, "sample_rate": rate, "frame": np.arange(first, first + count), "start": np.arange(first, first + count) * hop, "level_db": level, "voicing": voicing, "zero": ~x.any(axis=1)})

    return cut.mapInPandas(find, "file string, sample_rate int, frame long, start long, level_db double, voicing double, zero boolean")


def speech(frames: DataFrame) -> DataFrame:
    """The frames that are pitched narration."""
    return frames.where(~F.col("zero") & (F.col("voicing") > SPEECH["voicing"]) & (F.col("level_db") > SPEECH["level_db"]))


def narration(files: DataFrame, frames: DataFrame) -> DataFrame:
    """file, narration_db of every file: the median level of its speech, null where there is none."""
    voiced = stored(speech(frames).select("file", "level_db"), "speech")  # read once a round
    levels = quantiles.percentiles(voiced, ["file"], "level_db", {"narration_db": 0.5})
    return files.select("file").distinct().join(levels, "file", "left")


def local_speech(spans: DataFrame, frames: DataFrame, levels: DataFrame) -> DataFrame:
    """spans (file, sample_rate, start, stop and others) with speech_db: the median of the speech frames around each, else the file's narration.

    Frames meet spans by file and ten-second bucket, never by file alone.
    """
    width = F.lit(SPEECH["around_s"]) * F.col("sample_rate")
    keyed = spans.withColumn("_span", F.struct("file", "start", "stop"))
    reach = keyed.select("file", "_span", "start", "stop", width.alias("w"))
    buckets = reach.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - F.col("w")) / F.col("w")), F.floor((F.col("stop") + F.col("w")) / F.col("w")))))
    voiced = speech(frames).select("file", F.floor(F.col("start") / width).alias("_b"), F.col("start").alias("at"), "level_db")
    near = (F.col("at") >= F.col("start") - F.col("w")) & (F.col("at") < F.col("stop") + F.col("w"))
    found = buckets.join(voiced, ["file", "_b"]).where(near).groupBy("_span").agg(F.percentile("level_db", F.lit(0.5)).alias("_near"), F.count("*").alias("_n"))
    out = keyed.join(found, "_span", "left").join(levels, "file", "left")
    return out.withColumn("speech_db", F.when(F.col("_n") >= SPEECH["least"], F.col("_near")).otherwise(F.col("narration_db"))).drop("_span", "_near", "_n", "narration_db")


def _edges(loud: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of the envelope with first and last: the single bins in which the sound starts and ends."""
    ahead = ACTIVITY["envelope"] - 1
    near = runs.select("file", "start", "stop", F.explode(F.concat(F.sequence("start", F.col("start") + ahead), F.sequence(F.greatest(F.col("stop") - 1, F.lit(0)), F.col("stop") + ahead - 1))).alias("bin")).distinct()
    hit = near.join(loud, ["file", "bin"]).groupBy("file", "start", "stop").agg(
        F.min(F.when(F.col("bin") <= F.col("start") + ahead, F.col("bin"))).alias("first"), F.max(F.when(F.col("bin") >= F.col("stop") - 1, F.col("bin"))).alias("last")
    )
    both = runs.join(hit, ["file", "start", "stop"], "left")
    return both.select("file", F.coalesce("first", "start").alias("first"), F.coalesce("last", F.col("stop") - 1).alias("last"))


def activity(files: DataFrame, table: DataFrame, levels: DataFrame, breaths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sounds, pauses) from bins and narration levels.

    sounds: file, sample_rate, n_samples, threshold_db, floor_db, first_sound, last_sound of every readable file; nulls where nothing sounds. pauses: file, sample_rate, start, stop of the
    gaps of 0.25 s or more between sounds. breaths (file, start, stop) count as gap; sounds shorter than 30 ms are clicks.
    """
    a = ACTIVITY
    env = seq.envelope(table, ["file"], "bin", F.col("power"), a["envelope"], chunk=STRETCH)
    env = stored(env.withColumn("db", 10 * F.log10(F.greatest(F.coalesce("env", F.lit(0.0)), F.lit(kernels.FLOOR)))), "envelope")
    audible = F.when(F.col("db") > a["black_db"], F.col("db"))
    shares = env.groupBy("file").agg((F.count(audible) > (1 - a["black_share"]) * F.count("*")).alias("enough"))
    lows = quantiles.percentiles(env.select("file", audible.alias("db")), ["file"], "db", {"low": 0.1})
    floors = shares.join(lows, "file").select("file", F.when(F.col("enough"), F.col("low")).alias("floor_db"))
    limits = floors.join(levels, "file", "left")
    over = F.greatest(F.col("floor_db") + a["above_floor"], F.col("narration_db") - a["below_narration"])
    limits = limits.select("file", "floor_db", F.least(F.coalesce(over, F.lit(a["black_db"])), F.col("narration_db") - a["under_narration"]).alias("threshold_db"))
    heard = env.join(limits, "file").where("db >= threshold_db").select("file", "sample_rate", "bin", "power", "threshold_db")
    sound = heard
    if breaths is not None:
        h = F.greatest(F.lit(1), F.round(F.col("sample_rate") / 1000)).cast("long")
        rated = breaths.join(files.select("file", "sample_rate"), "file")
        masked = rated.select("file", F.explode(F.sequence(F.floor(F.col("start") / h), F.ceil(F.col("stop") / h) - 1)).alias("bin")).distinct()
        sound = sound.join(masked, ["file", "bin"], "left_anti")
    runs = seq.runs(sound, ["file"], "bin", F.lit(True), chunk=STRETCH).where(F.col("length") >= a["click_bins"])
    loud = table.join(limits, "file").where(10 * F.log10(F.greatest("power", F.lit(kernels.FLOOR))) >= F.col("threshold_db")).select("file", "bin")
    edges = _edges(loud, runs)
    h = F.greatest(F.lit(1), F.round(F.col("sample_rate") / 1000)).cast("long")
    ends = edges.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    known = files.where("error is null").select("file", "sample_rate", "n_samples")
    sounds = known.join(limits, "file", "left").join(ends, "file", "left").select(
        "file", "sample_rate", "n_samples", "threshold_db", "floor_db", (F.col("first") * h).alias("first_sound"), ((F.col("last") + 1) * h).alias("last_sound")
    )
    after = F.lead("first").over(seq.within(["file"], "first"))
    gaps = edges.withColumn("next", after).where("next is not null").join(known, "file")
    gaps = gaps.select("file", "sample_rate", ((F.col("last") + 1) * h).alias("start"), (F.col("next") * h).alias("stop"))
    return sounds, gaps.where(F.col("stop") - F.col("start") >= a["pause_s"] * F.col("sample_rate"))


def _end_note(seconds: Column, target: float, what: str) -> Column:
    off = F.round(seconds - target, 3)
    text = F.format_string(f"{what}: %.2f s %s than the {target:g} s rule", F.abs(off), F.when(off > 0, "longer").otherwise("shorter"))
    return F.when(F.abs(off) <= RULES["end_tolerance"], F.lit(f"{what}: matches the {target:g} s rule")).otherwise(text)


def pause_map(sounds: DataFrame, pauses: DataFrame, rule_set: str = "standard") -> DataFrame:
    """file, sample_rate, start, stop, kind (head, internal, tail), guess: every file's pauses in order. A file without sound is one head."""
    shown = F.round(F.round((F.col("stop") - F.col("start")) * 1000 / F.col("sample_rate")) / 1000, 2)
    low, high = RULES["break"] - RULES["break_tolerance"], RULES["break"] + RULES["break_tolerance"]
    is_break = shown.between(low, high)
    heading = is_break & (F.col("start") / F.col("sample_rate") <= RULES["heading_within"])
    first = heading & (F.count_if(heading).over(seq.within(["file"], "start").rowsBetween(W.unboundedPreceding, 0)) == 1)
    span = PARAGRAPHS[rule_set]
    short = F.lit("sentence or paragraph pause")
    if span:
        short = F.when(shown.between(*span), "paragraph break").when(shown > span[1], "between paragraph and section length").otherwise("shorter than a paragraph break")
    guess = F.when(first, "after chapter heading (likely)").when(is_break, "section break").when(shown > high, "longer than a section break").otherwise(short)
    inner = pauses.select("file", "sample_rate", "start", "stop", F.lit("internal").alias("kind"), guess.alias("guess"))
    silent = F.col("first_sound").isNull()
    zero = F.lit(0).cast("long")
    head = sounds.select("file", "sample_rate", zero.alias("start"), F.coalesce("first_sound", "n_samples").alias("stop"), F.lit("head").alias("kind"), silent.alias("silent"))
    head = head.select("file", "sample_rate", "start", "stop", "kind", F.when(F.col("silent"), "no narration found").otherwise(_end_note(shown, RULES["head"], "chapter start")).alias("guess"))
    tail = sounds.where(~silent).select("file", "sample_rate", F.col("last_sound").alias("start"), F.col("n_samples").alias("stop"), F.lit("tail").alias("kind"))
    tail = tail.select("file", "sample_rate", "start", "stop", "kind", _end_note(shown, RULES["tail"], "chapter end").alias("guess"))
    return head.unionByName(inner).unionByName(tail)
