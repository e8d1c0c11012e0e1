"""Planted tones in made-up narration, and the parts of the hum check."""

import numpy as np
import pandas as pd
import pytest
from sounds import RATE, narration, phrase, room, tone, write

from reedline.operators import hum, voice
from reedline.sources import wav
from reedline.sources.shared import stored


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """The hums of all files at once, by name."""
    folder = tmp_path_factory.mktemp("hums")
    base = narration(24)
    speech = np.concatenate([np.concatenate([phrase(4), room(1.0, seed=k)]) for k in range(9)])

    def add(x, y, at):
        x = x.copy()
        x[at : at + len(y)] += y
        return x

    sounds = {
        "clean": speech,
        "steady": speech + tone(len(speech) / RATE, 120.5, -60)[: len(speech)],
        "loud": add(speech, tone(8, 60.0, -48), 6 * RATE),
        "broken": add(speech, tone(10, 333.0, -52), 6 * RATE),
        "fading": add(np.concatenate([phrase(), room(20), phrase()]), tone(12, 60.0, -58, fade=3.0), 6 * RATE),
        "two": speech + sum(tone(len(speech) / RATE, f, db)[: len(speech)] for f, db in ((43, -65), (99, -56), (142, -80), (86, -74))),
        "harmonic": speech + tone(len(speech) / RATE, 50, -62)[: len(speech)] + tone(len(speech) / RATE, 150, -58)[: len(speech)],
        "short": add(base, tone(1.5, 300, -50), 8 * RATE),
        "two_seconds": add(base, tone(2.0, 300, -50), 8 * RATE),
        "three_seconds": add(base, tone(3.0, 300, -50), 8 * RATE),
    }
    for name, x in sounds.items():
        write(folder / f"{name}.wav", x)
    files = stored(wav.files(spark, str(folder)), "files")
    cut = stored(wav.chunks(spark, str(folder), 300_000, hum.MARGIN_S), "chunks")
    levels = voice.narration(files, voice.speech_frames(cut))
    out = {n: [] for n in sounds}
    for row in hum.hums(files, cut, stored(voice.bins(cut), "bins"), levels).collect():
        out[row.file.rsplit("/", 1)[1][:-4]].append(row)
    return out


def test_a_steady_tone_is_one_hum(found):
    (row,) = found["steady"]
    assert abs(row.hz - 120.5) < 0.3 and abs(row.level_db + 60) < 1 and row.severity == 1
    assert row.problem == "hum 120.5 Hz, -60 dBFS" and row.start < 2 * RATE and row.stop > 20 * RATE


def test_clean_narration_and_short_tones_have_none(found):
    assert found["clean"] == [] and found["short"] == [] and found["two_seconds"] == [] and found["three_seconds"] == []


def test_an_abrupt_hum_is_graded_three_and_a_fading_one_less(found):
    (row,) = found["loud"]
    assert row.severity == 3 and "starts abruptly" in row.problem and "cuts off abruptly" in row.problem
    assert abs(row.start / RATE - 6) < 0.6 and abs(row.stop / RATE - 14) < 0.6
    (soft,) = found["fading"]
    assert "abruptly" not in soft.problem and soft.severity == 1


def test_a_hum_whose_track_speech_breaks_is_one(found):
    assert len(found["broken"]) == 1
    row = found["broken"][0]
    assert abs(row.hz - 333) < 0.3 and abs(row.start / RATE - 6) < 1.5 and abs(row.stop / RATE - 16) < 1.5 and row.severity >= 2


def test_headline_harmonics_and_other_lines(found):
    rows = found["two"]
    main = next(r for r in rows if any(abs(f - 99) < 0.5 for f in r.heads_hz) or abs(r.hz - 43) < 0.5)
    named = {round(f) for r in rows for f in r.heads_hz} | {h for r in rows for h in [*r.harmonics_hz, *r.others_hz]}
    assert {43, 99, 86, 142} <= named and main.severity == 1
    (one,) = found["harmonic"]
    assert abs(one.hz - 50) < 0.3 and 150 in one.harmonics_hz and "at 150 Hz" in one.problem


def test_tracks_follow_the_nearest_line_and_close_after_two_misses():
    rows = [(w, 100 + 0.1 * w, -50.0) for w in range(10) if w not in (4, 5)] + [(w, 100.0 + 0.1 * w + 5, -60.0) for w in range(3)] + [(w, 200.0, -55.0) for w in (0, 1, 6, 7)]
    lines = pd.DataFrame([(w, hz, db, 12.0) for w, hz, db in rows], columns=["window", "hz", "level_db", "prominence_db"])
    sizes = sorted(len(t) for t in hum._follow(lines))
    assert sizes == [2, 2, 3, 8]
    joined = hum._joined([[(w, 100.0, -50, 12) for w in range(7)], [(w, 100.3, -50, 12) for w in range(11, 18)], [(w, 300.0 + w, -50, 12) for w in range(9)]])
    assert [len(t) for t in joined] == [14]


@pytest.mark.parametrize(("windows", "kept"), [(3, 0), (5, 0), (6, 0), (7, 1), (8, 1)])
def test_a_track_lasts_three_seconds_from_first_to_last_window(windows, kept):
    assert len(hum._joined([[(w, 100.0, -50, 12) for w in range(windows)]])) == kept


def test_harmonics_go_with_their_tone(spark):
    rows = [("f", k, hz, a, b, -50.0, -50.0, -50.0, -50.0, 12.0) for k, (hz, a, b) in enumerate([(50.0, 0, 40), (100.1, 0, 40), (987.0, 0, 40), (150.0, 38, 80), (250.4, 5, 30)])]
    got = {r.track: r.base for r in hum.grouped(spark.createDataFrame(rows, hum._TRACK)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}


def test_gaps_that_a_loud_hum_fills_need_a_twin(spark):
    table = spark.range(8000).selectExpr("'f' AS file", "44100 AS sample_rate", "id AS bin", "1e-4D AS power")
    gaps = [("f", 44_100, 44_100 * a, 44_100 * a + 22_050) for a in (1, 3, 5)]
    lines = [("f", g[2], g[3], hz, -40.5) for g, hz in zip(gaps, (300.0, 300.2, 400.0))]
    got = hum.filled_gaps(table, spark.createDataFrame(gaps, "file string, sample_rate int, start long, stop long"), spark.createDataFrame(lines, "file string, start long, stop long, hz double, line_db double"))
    assert sorted(r.start for r in got.collect()) == [44_100, 132_300]


def test_lines_that_recur_in_pauses(spark):
    schema = "file string, start long, stop long, hz double, line_db double"
    rows = [("f", 44_100 * a, 44_100 * a + 30_000, hz, -60.0) for a, hz in ((1, 120.0), (4, 120.2), (7, 119.9), (30, 120.0), (32, 121.5), (2, 500.0))] + [("f", 44_100 * 8, 44_100 * 9, 700.0, -75.0)]
    got = hum.hidden(spark.createDataFrame(rows, schema), spark.createDataFrame([("f", 44_100)], "file string, sample_rate int")).collect()
    assert [(r.pauses, round(r.hz, 1)) for r in got] == [(3, 120.0)]


def test_levels_of_one_frequency_in_pauses(spark, tmp_path):
    x = np.concatenate([tone(1.0, 200, -40), room(1.0, -90), tone(0.1, 200, -40)])
    write(tmp_path / "a.wav", x)
    name = wav.files(spark, str(tmp_path)).first().file
    asked = [(name, 0, RATE, 200.0), (name, 0, RATE, 300.0), (name, RATE, 2 * RATE, 200.0), (name, 2 * RATE, 2 * RATE + 4000, 200.0)]
    got = {(r.start, r.hz): r.level_db for r in hum.pause_levels(wav.chunks(spark, str(tmp_path), 20_000, hum.MARGIN_S), spark.createDataFrame(asked, "file string, start long, stop long, hz double")).collect()}
    assert abs(got[0, 200.0] + 40) < 0.3 and got[0, 300.0] < -80 and got[RATE, 200.0] < -85 and got[2 * RATE, 200.0] is None


def test_a_cut_that_lands_on_a_word(spark, tmp_path):
    x = np.concatenate([room(1.0), phrase(3), room(1.0), phrase(3), room(1.0), phrase(3), room(1.0)])
    at = int(6.0 * RATE)
    y = x.copy()
    y[:at] += tone(6.0, 60, -50)
    write(tmp_path / "a.wav", y)
    files, cut = wav.files(spark, str(tmp_path)), wav.chunks(spark, str(tmp_path), 100_000, hum.MARGIN_S)
    name = files.first().file
    tones = spark.createDataFrame([(name, "t0", 60.0, -50.0, 0.0, 6.2, RATE)], "file string, hum string, hz double, full_db double, start_s double, stop_s double, sample_rate int")
    levels = voice.narration(files, voice.speech_frames(cut))
    (row,) = hum.word_cuts(cut, tones, hum.pauses_of(cut, voice.bins(cut), levels)).collect()
    assert (row.cut_start, row.cut_end) == (False, True)


def test_a_tone_that_pauses_carry_grows_outwards_from_its_track(spark):
    pauses = [("f", RATE * a, RATE * (a + 1)) for a in (2, 6, 10, 14, 18, 40)]
    heard = [("f", a, b, hz, db) for (_, a, b), hz, db in zip(pauses, (200.0, 200.4, 200.1, 199.8, 200.2, 200.0), (-50.0, -52.0, -51.0, -50.5, -70.0, -50.0))]
    tones = [("f", 1, RATE, 200.0, 9.0, 12.0), ("f", 2, RATE, 500.0, 9.0, 12.0)]
    spans = "file string, start long, stop long"
    args = spark.createDataFrame(tones, "file string, track int, sample_rate int, hz double, start_s double, stop_s double"), spark.createDataFrame(heard, f"{spans}, hz double, line_db double"), spark.createDataFrame(pauses, spans)
    (row,) = hum.carrying(*args).collect()
    # the loud pause at 18 s ends it, so the one at 40 s isn't reached
    assert (row.track, row.from_s, row.to_s, row.outside) == (1, 2.0, 15.0, True)
    (row,) = hum.carrying(args[0], args[1].where("start <> %d" % (6 * RATE)), args[2]).collect()
    assert (row.from_s, row.to_s) == (10.0, 15.0)


@pytest.mark.parametrize("fade", [0.0, 1.2])
def test_edges_between_pauses(spark, tmp_path, fade):
    x = np.concatenate([room(1.0), phrase(4), room(1.0), phrase(4), room(1.0), phrase(4), room(1.0), phrase(4), room(1.0)])
    word = len(phrase(4))
    starts, ends = RATE + word // 2, len(x) - RATE - word // 2
    y = x.copy()
    held = tone((ends - starts) / RATE, 60.0, -45, fade=fade)
    y[starts : starts + len(held)] += held
    write(tmp_path / "a.wav", y)
    files, cut = wav.files(spark, str(tmp_path)), wav.chunks(spark, str(tmp_path), 100_000, hum.MARGIN_S)
    name = files.first().file
    at = [0, RATE + word, 2 * RATE + 2 * word, 3 * RATE + 3 * word, len(x) - RATE]
    pauses = spark.createDataFrame([(name, a, a + RATE) for a in at], "file string, start long, stop long")
    asked = spark.createDataFrame([(name, "p", 60.0, -45.0, at[1] / RATE, (at[3] + RATE) / RATE, RATE)], "file string, hum string, hz double, full_db double, start_s double, stop_s double, sample_rate int")
    rows = hum.pause_edges(cut, asked, pauses).collect()
    if fade:
        assert all(r.cut_start_s is None and r.cut_end_s is None for r in rows)
    else:
        (row,) = rows
        assert abs(row.cut_start_s - starts / RATE) < 0.3 and abs(row.cut_end_s - ends / RATE) < 0.3


def test_a_loud_tone_fills_gaps_at_its_level(spark):
    table = spark.range(6000).selectExpr("'f' AS file", "44100 AS sample_rate", "id AS bin", "CASE WHEN id BETWEEN 2000 AND 2999 THEN 1e-4D ELSE 1e-2D END AS power")
    tones = spark.createDataFrame([("f", 1, 44_100, 0.5, 5.5, -40.0, -18.0), ("f", 2, 44_100, 0.5, 5.5, -60.0, -18.0), ("f", 3, 44_100, 0.5, 5.5, -30.0, -18.0), ("f", 4, 44_100, 2.5, 5.5, -40.0, -18.0)], "file string, track int, sample_rate int, start_s double, stop_s double, level_db double, narration_db double")
    got = {r.track: (r.start, r.stop) for r in hum.gaps_at_level(table, tones).collect()}
    assert set(got) == {1, 4} and abs(got[1][0] / 44_100 - 2.0) < 0.06 and abs(got[1][1] / 44_100 - 3.0) < 0.06 and got[4][0] / 44_100 >= 2.5


def low_rate(path, x, rate=4410):
    """A file at a rate that is analysed as it is."""
    import struct

    body = np.round(x * 2**15).astype("<i2").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16)
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + form + b"data" + struct.pack("<I", len(body)) + body)


def sines(seconds, lines, rate=4410, noise_db=-75.0):
    t = np.arange(int(seconds * rate)) / rate
    x = np.random.default_rng(3).standard_normal(len(t)) * 10 ** (noise_db / 20)
    for hz, db in lines:
        x += 10 ** (db / 20) * 2**0.5 * np.sin(2 * np.pi * hz * t + hz)
    return x


def test_bands_of_a_long_pause_equal_its_whole_spectrum(spark, tmp_path, monkeypatch):
    planted = [(60.3, -60), (99.5, -72), (440.52, -66), (444.1, -70), (998.7, -64)]
    x = np.concatenate([room(2.0, -30, 4410), sines(90, planted), room(2.0, -30, 4410)])
    low_rate(tmp_path / "a.wav", x)
    name = wav.files(spark, str(tmp_path)).first().file
    cut = stored(wav.chunks(spark, str(tmp_path), 50_000, hum.MARGIN_S), "chunks")
    pause = spark.createDataFrame([(name, 2 * 4410, 92 * 4410)], "file string, start long, stop long")
    tones = pause.selectExpr("*", "explode(array(60.0D, 440.0D, 700.0D)) AS hz")
    long = sorted((r.hz, r.line_db) for r in hum.pause_lines(cut, pause).collect() if r.line_db > -90)
    long_levels = {r.hz: r.level_db for r in hum.pause_levels(cut, tones).collect()}
    monkeypatch.setitem(hum.LONG, "from_s", 1000.0)
    whole = sorted((r.hz, r.line_db) for r in hum.pause_lines(cut, pause).collect() if r.line_db > -90)
    levels = {r.hz: r.level_db for r in hum.pause_levels(cut, tones).collect()}
    assert [round(f, 1) for f, _ in long] == [round(f, 1) for f, _ in planted] and len(whole) == len(long)
    for (f, a), (g, b) in zip(long, whole):
        assert abs(f - g) < 0.01 and abs(a - b) < 0.1
    assert set(levels) == set(long_levels) and all(abs(levels[f] - long_levels[f]) < 0.1 for f in (60.0, 440.0)) and abs(levels[700.0] - long_levels[700.0]) < 1.5


def test_an_hour_of_silence_is_one_pause_and_many_groups(spark, tmp_path):
    planted = [(50.01, -70), (333.3, -80)]
    x = sines(3600, planted)
    low_rate(tmp_path / "a.wav", x)
    name = wav.files(spark, str(tmp_path)).first().file
    cut = stored(wav.chunks(spark, str(tmp_path), 1 << 20, hum.MARGIN_S), "chunks")
    pause = spark.createDataFrame([(name, 0, len(x))], "file string, start long, stop long")
    found = sorted((r.hz, r.line_db) for r in hum.pause_lines(cut, pause).collect() if r.line_db > -100)
    assert len(found) == 2 and all(abs(f - g) < 0.005 and abs(a - b) < 0.1 for (f, a), (g, b) in zip(found, planted))
