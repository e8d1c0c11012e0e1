"""Sound files, planted holes and invalid samples, tensor files: written byte by byte here, found by Spark."""

import json
import struct

import numpy as np
import pytest

from reedline.operators import sound
from reedline.sources import wav, weights

RATE = 44_100


def _wav(path, x, bits=16, rate=RATE, channels=1, claimed=None, kind=1):
    x = np.asarray(x, np.float64)
    if kind == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = np.round(x * 2**23).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.round(x * 2 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, rate, rate * block, block, bits)
    odd = struct.pack("<4sI", b"note", 3) + b"abc\0"
    data = struct.pack("<4sI", b"data", len(body) if claimed is None else claimed) + body
    rest = b"WAVE" + odd + form + data
    path.write_bytes(b"RIFF" + struct.pack("<I", len(rest)) + rest)


def _tone(seconds, level=0.2, rate=RATE):
    return level * np.cos(2 * np.pi * 150 * np.arange(int(seconds * rate)) / rate + 0.1)


@pytest.mark.parametrize("bits,kind,within", [(8, 1, 0.01), (16, 1, 1e-4), (24, 1, 1e-6), (32, 1, 1e-7), (32, 3, 1e-7), (64, 3, 1e-7)])
def test_samples_come_back(spark, tmp_path, bits, kind, within):
    x = _tone(0.3)
    _wav(tmp_path / "a.WAV", x, bits, kind=kind)
    got = wav.samples(wav.chunks(spark, str(tmp_path), 1000)).orderBy("i").toPandas()
    assert list(got["i"]) == list(range(len(x)))
    assert np.abs(got["v"] - x).max() < within


def test_files_with_errors_are_rows(spark, tmp_path):
    _wav(tmp_path / "good.wav", _tone(1.5), claimed=10**6)
    _wav(tmp_path / "same.wav", np.repeat(_tone(0.5), 2), channels=2)
    _wav(tmp_path / "differ.wav", np.stack([_tone(0.5), 0 * _tone(0.5)], 1).ravel(), channels=2)
    _wav(tmp_path / "empty.wav", [])
    (tmp_path / "text.wav").write_text("not sound")
    (tmp_path / "head.wav").write_bytes(b"RIFF")
    (tmp_path / "other.txt").write_text("left out")
    found = wav.files(spark, str(tmp_path))
    rows = {r["file"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == {"good.wav", "same.wav", "differ.wav", "empty.wav", "text.wav", "head.wav"}
    assert rows["good.wav"]["n_samples"] == int(1.5 * RATE) and rows["good.wav"]["error"] is None
    assert rows["same.wav"]["note"] and "differ" in rows["differ.wav"]["error"] and rows["empty.wav"]["error"] and rows["text.wav"]["error"]
    cut = wav.chunks(spark, str(tmp_path))
    told = {(r["file"].rsplit("/", 1)[1], r["problem"].split(":")[0]) for r in sound.file_problems(found, sound.invalid_stretches(cut)).collect()}
    assert told == {("good.wav", "file is cut short"), ("same.wav", "file is only 500 ms long")} | {(n, "skipped") for n in ("differ.wav", "empty.wav", "text.wav", "head.wav")}


def _holes(level, zeros, at=1.0, bits=24, rate=RATE):
    x = _tone(2.0, 10 ** (level / 20) * 2**0.5, rate)
    x[int(at * rate) : int(at * rate) + zeros] = 0
    return x


@pytest.mark.parametrize("level,zeros,listed", [(-20, 200, 1), (-44, 10, 1), (-47, 200, 0), (-20, 4, 0), (-20, int(0.04 * RATE), 0), (-20, 1472, 1), (-20, 1473, 0)])
@pytest.mark.parametrize("size", [997, 65_536])
def test_planted_dropouts(spark, tmp_path, level, zeros, listed, size):
    _wav(tmp_path / "a.wav", _holes(level, zeros), 24)
    got = sound.dropouts(wav.chunks(spark, str(tmp_path), size, sound.MARGIN_S)).collect()
    assert [(r["start"], r["stop"]) for r in got] == [(RATE, RATE + zeros)] * listed


def test_no_dropout_at_the_edges_or_in_eight_bits(spark, tmp_path):
    _wav(tmp_path / "start.wav", _holes(-20, 100, 0.001), 24)
    _wav(tmp_path / "stop.wav", _holes(-20, 100, 1.996), 24)
    _wav(tmp_path / "eight.wav", _holes(-20, 200), 8)
    assert sound.dropouts(wav.chunks(spark, str(tmp_path))).count() == 0


def test_zero_runs_cross_chunks(spark, tmp_path):
    x = np.r_[np.zeros(5), np.full(10, 0.5), np.zeros(2500), [0.5], np.zeros(1)]
    _wav(tmp_path / "a.wav", x)
    got = sound.zero_runs(wav.chunks(spark, str(tmp_path), 1000)).orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in got] == [(0, 5), (15, 2515), (2516, 2517)]


def test_invalid_samples(spark, tmp_path):
    x = _tone(30.0, rate=1000)
    x[[5, 6, 2000]] = [np.nan, 1e10, np.inf]
    x[4000::1002] = np.nan
    _wav(tmp_path / "a.wav", x, 32, rate=1000, kind=3)
    cut = wav.chunks(spark, str(tmp_path), 500)
    got = [tuple(r)[1:] for r in sound.invalid_stretches(cut).orderBy("start").collect()]
    assert got[:3] == [(5, 7, 2), (2000, 2001, 1), (4000, 4001, 1)] and len(got) == 20
    assert sum(n for *_, n in got) == 3 + len(x[4000::1002]) and got[-1][2] > 1
    assert wav.samples(cut).where("i in (5, 6, 2000) and v <> 0").count() == 0


def _tensors(path, header, data):
    text = json.dumps(header).encode() if not isinstance(header, bytes) else header
    path.write_bytes(len(text).to_bytes(8, "little") + text + data)


def test_tensor_files(spark, tmp_path):
    def one(a, b, shape, dtype="F32"):
        return {"dtype": dtype, "shape": shape, "data_offsets": [a, b]}

    data = np.arange(6, dtype="<f4").tobytes()
    _tensors(tmp_path / "good", {"b": one(8, 24, [2, 2]), "a": one(0, 8, [2]), "__metadata__": {"k": "v"}}, data)
    bad = {
        "gap": {"a": one(4, 24, [5])}, "overlap": {"a": one(0, 16, [4]), "b": one(8, 24, [4])}, "tail": {"a": one(0, 16, [4])},
        "type": {"a": one(0, 24, [6], "F16")}, "shape": {"a": one(0, 24, [5])}, "negative": {"a": one(0, 24, [-6])}, "bool": {"a": one(0, 24, [True, 6])}, "meta": {"__metadata__": {"k": 1}, "a": one(0, 24, [6])},
    }
    for name, header in bad.items():
        _tensors(tmp_path / name, header, data)
    _tensors(tmp_path / "json", b"{", data)
    (tmp_path / "length").write_bytes(b"\xff" * 8)
    (tmp_path / "short").write_bytes(b"abc")
    rows = weights.tensors(spark, str(tmp_path)).collect()
    good = {r["name"]: (r["shape"], r["values"]) for r in rows if r["error"] is None}
    assert good == {"a": ([2], [0.0, 1.0]), "b": ([2, 2], [2.0, 3.0, 4.0, 5.0])}
    assert {r["file"].rsplit("/", 1)[1] for r in rows if r["error"]} == set(bad) | {"json", "length", "short"}


def test_all_broken_rules_are_told_and_checksums_compared(spark, tmp_path):
    import hashlib

    data = np.arange(6, dtype="<f4").tobytes()
    _tensors(tmp_path / "a", {"x": {"dtype": "F32", "shape": [2], "data_offsets": [4, 12]}, "y": {"dtype": "F32", "shape": [9], "data_offsets": [12, 20]}, "__metadata__": {"k": "v"}}, data)
    (row,) = weights.tensors(spark, str(tmp_path / "a")).collect()
    assert [e.split(":")[0] for e in row.error.split("; ")] == ["y", "x", "end of the data"]
    _tensors(tmp_path / "b", {"x": {"dtype": "F32", "shape": [6], "data_offsets": [0, 24]}, "__metadata__": {"k": "v"}}, data)
    raw = (tmp_path / "b").read_bytes()
    path, sha = str(tmp_path / "b"), hashlib.sha256(raw).hexdigest()
    assert weights.tensors(spark, path, sha, len(raw)).first().error is None
    assert weights.tensors(spark, path, "0" * 64, len(raw)).first().error == "checksum is not the expected one"
    assert "size" in weights.tensors(spark, path, sha, 5).first().error and weights.tensors(spark, path, metadata=False).first().error == "metadata is not allowed"


@pytest.mark.parametrize("claimed, listed", [(0xFFFFFFFF, 0), (0x7FFFFFFF, 0), (88_201, 0), (88_202, 1), (0, 0)])
def test_a_file_is_cut_short_by_a_whole_frame_only(spark, tmp_path, claimed, listed):
    _wav(tmp_path / "a.wav", _tone(1.0), claimed=claimed if claimed else None)
    cut = wav.chunks(spark, str(tmp_path))
    told = sound.file_problems(wav.files(spark, str(tmp_path)), sound.invalid_stretches(cut)).collect()
    assert [r.problem.split(":")[0] for r in told] == ["file is cut short"] * listed
    assert all(r.start == r.stop == RATE for r in told)


def test_files_without_narration_are_listed(spark, tmp_path):
    _wav(tmp_path / "tone.wav", np.zeros(2 * RATE) + 0.001)
    files = wav.files(spark, str(tmp_path))
    levels = files.selectExpr("file", "cast(null AS double) AS narration_db")
    told = sound.file_problems(files, sound.invalid_stretches(wav.chunks(spark, str(tmp_path))), levels).collect()
    assert [r.problem for r in told] == ["no narration found in the file"]


def test_gates_by_rate_and_depth(spark, tmp_path):
    for name, rate, bits in (("a", 11_025, 16), ("b", 16_000, 16), ("c", 32_000, 16), ("d", 44_100, 8), ("e", 44_100, 24)):
        _wav(tmp_path / f"{name}.wav", _tone(1.0, rate=rate), bits, rate=rate)
    got = {r.file.rsplit("/", 1)[1][0]: r for r in sound.gates(wav.files(spark, str(tmp_path))).collect()}
    assert {k: (r.breaths, r.dropouts, r.plosives, r.ticks, len(r.notes)) for k, r in got.items()} == {
        "a": (False, True, False, False, 3), "b": (True, True, False, False, 2), "c": (True, True, True, False, 1), "d": (True, False, True, True, 1), "e": (True, True, True, True, 0),
    }
    assert got["a"].notes[0] == "breath check skipped: 11.025 kHz is below 16 kHz"
