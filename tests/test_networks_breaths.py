"""The networks against plain loops on tiny weights, kernels against plain sums, and the breath rules."""

import math

import numpy as np
import pytest
from sounds import RATE, phrase, rng, room, tone, write

from reedline.operators import breaths, defects, kernels, networks, voice
from reedline.sources import wav


def tiny(shapes, seed=1):
    r = rng(seed)
    out = {k: (0.3 * r.standard_normal(s)).astype(np.float32) for k, s in shapes.items()}
    return {k: np.abs(v) + 0.5 if k.endswith("running_var") or "norm.weight" in k else v for k, v in out.items()}


def plain_transformer(w, mel, heads):
    """Every frame, head and weight in a loop."""
    h = [w["input_projection.weight"] @ x + w["input_projection.bias"] for x in mel.astype(float)]
    size = len(h[0]) // heads

    def rms(x, name):
        return w[name] * x / math.sqrt((x * x).mean() + 1e-6)

    def turn(x, t):
        out = x.copy()
        for a in range(heads):
            for i in range(size // 2):
                angle = t / 10_000 ** (2 * i / size)
                p, q = a * size + i, a * size + i + size // 2
                out[p], out[q] = x[p] * math.cos(angle) - x[q] * math.sin(angle), x[q] * math.cos(angle) + x[p] * math.sin(angle)
        return out

    for n in range(2):
        at = f"backbone.layers.{n}."
        x = [rms(v, at + "input_layernorm.weight") for v in h]
        q, k, v = ([w[f"{at}self_attn.{c}_proj.weight"] @ y for y in x] for c in "qkv")
        q, k = [turn(y, t) for t, y in enumerate(q)], [turn(y, t) for t, y in enumerate(k)]
        new = []
        for t in range(len(h)):
            mixed = np.zeros(len(h[0]))
            for a in range(heads):
                part = slice(a * size, (a + 1) * size)
                e = np.exp([q[t][part] @ k[s][part] / math.sqrt(size) for s in range(t + 1)])
                mixed[part] = sum(x * v[s][part] for s, x in enumerate(e / e.sum()))
            y = h[t] + w[at + "self_attn.o_proj.weight"] @ mixed
            z = rms(y, at + "post_attention_layernorm.weight")
            g = w[at + "mlp.gate_proj.weight"] @ z
            new.append(y + w[at + "mlp.down_proj.weight"] @ (g / (1 + np.exp(-g)) * (w[at + "mlp.up_proj.weight"] @ z)))
        h = new
    return np.array([w["classifier.weight"] @ rms(y, "backbone.norm.weight") + w["classifier.bias"] for y in h])


def test_transformer_equals_a_plain_loop():
    w = networks.checked(tiny(networks.truncation_shapes(4, 8, 12, 2, 3)), networks.truncation_shapes(4, 8, 12, 2, 3))
    mel = rng(2).standard_normal((9, 4))
    want = plain_transformer(w, mel, 2)
    assert networks.truncation_logits(w, mel, 2) == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert networks.truncation_logits(w, mel, 2, last=1) == pytest.approx(want[-1:], rel=1e-5, abs=1e-6)


def test_weights_of_other_shapes_are_refused():
    shapes = networks.truncation_shapes(4, 8, 12, 1, 3)
    for change in ({"backbone.norm.weight": np.zeros(9)}, {"more": np.zeros(1)}):
        with pytest.raises(ValueError):
            networks.checked(tiny(shapes) | change, shapes)
    assert len(networks.truncation_shapes()) == 6 + 8 * 9 and networks.breath_shapes()["linear.weight"] == (128, 31)
    assert sum(math.prod(s) for s in networks.truncation_shapes().values()) * 4 == pytest.approx(51_820_912, rel=1e-3)
    assert sum(math.prod(s) for s in networks.breath_shapes().values()) * 4 == pytest.approx(11_713_964, rel=5e-3)


def test_a_run_goes_on_without_weights_that_do_not_fit(spark, tmp_path):
    import json

    from reedline.sources import weights

    shapes = {"a": (2,), "b": (1, 2)}
    header = {"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "F32", "shape": [1, 2], "data_offsets": [8, 16]}}
    text = json.dumps(header).encode()
    (tmp_path / "w").write_bytes(len(text).to_bytes(8, "little") + text + np.arange(4, dtype="<f4").tobytes())
    found, state = networks.loaded(weights.tensors(spark, str(tmp_path / "w")), shapes)
    assert state == "on" and found["b"].tolist() == [[2.0, 3.0]]
    found, state = networks.loaded(weights.tensors(spark, str(tmp_path / "w")), shapes | {"c": (1,)})
    assert found is None and state.startswith("off: weights don't fit")
    found, state = networks.loaded(weights.tensors(spark, str(tmp_path / "w"), sha256="0" * 64), shapes)
    assert found is None and state == "off: checksum is not the expected one"


def test_candidates_as_loud_as_speech_go_unless_a_network_decides(spark):
    c = spark.createDataFrame([("f", 1000, 0, 200), ("f", 1000, 500, 700)], "file string, sample_rate int, start long, stop long")
    frames = spark.createDataFrame([("f", k, -20.0 if k < 20 else -50.0) for k in range(100)], "file string, frame long, level_db double")
    levels = spark.createDataFrame([("f", -18.0)], "file string, narration_db double")
    assert [r.start for r in breaths.not_speech(c, frames, levels, False).collect()] == [500]
    assert breaths.not_speech(c, frames, levels, True).count() == 2


def plain_breaths(w, feat, heads, layers):
    def sig(x):
        return 1 / (1 + np.exp(-x))

    def conv(x, name):
        if x.shape[2] % 2 == 0:
            x = np.concatenate([x, np.zeros((x.shape[0], x.shape[1], 1))], axis=2)
        k, b = w[name + ".weight"], w[name + ".bias"]
        out = np.zeros((1, (x.shape[1] - 3) // 2 + 1, (x.shape[2] - 3) // 2 + 1))
        for f in range(out.shape[1]):
            for t in range(out.shape[2]):
                out[0, f, t] = max(0, (k[0] * x[:, 2 * f : 2 * f + 3, 2 * t : 2 * t + 3]).sum() + b[0])
        return out

    def norm(x, name):
        return (x - x.mean()) / math.sqrt(x.var() + 1e-5) * w[name + ".weight"] + w[name + ".bias"]

    def line(x, name):
        return w[name + ".weight"].reshape(len(w[name + ".bias"]), -1) @ x + w[name + ".bias"]

    x = conv(conv(feat, "downsampling.conv1.0"), "downsampling.conv2.0")[0]
    rows = [line(x[:, t], "linear") for t in range(x.shape[1])]
    for n in range(layers):
        at = f"conformer.conformer_layers.{n}."

        def ffn(v, name):
            z = line(norm(v, f"{at}{name}.sequential.0"), f"{at}{name}.sequential.1")
            return line(z * sig(z), f"{at}{name}.sequential.4")

        rows = [v + ffn(v, "ffn1") / 2 for v in rows]
        qkv = [w[at + "self_attn.in_proj_weight"] @ norm(v, at + "self_attn_layer_norm") + w[at + "self_attn.in_proj_bias"] for v in rows]
        width = len(rows[0])
        size = width // heads
        new = []
        for t, v in enumerate(rows):
            mixed = np.zeros(width)
            for a in range(heads):
                p = slice(a * size, (a + 1) * size)
                e = np.exp([qkv[t][:width][p] @ o[width : 2 * width][p] / math.sqrt(size) for o in qkv])
                mixed[p] = sum(y * o[2 * width :][p] for y, o in zip(e / e.sum(), qkv))
            new.append(v + line(mixed, at + "self_attn.out_proj"))
        rows = new
        gated = [line(norm(v, at + "conv_module.layer_norm"), at + "conv_module.sequential.0") for v in rows]
        gated = [g[:width] * sig(g[width:]) for g in gated]
        taps = w[at + "conv_module.sequential.2.weight"][:, 0]
        half = taps.shape[1] // 2
        new = []
        for t, v in enumerate(rows):
            z = w[at + "conv_module.sequential.2.bias"] + sum(taps[:, k] * gated[t + k - half] for k in range(taps.shape[1]) if 0 <= t + k - half < len(rows))
            name = at + "conv_module.sequential.3."
            z = (z - w[name + "running_mean"]) / np.sqrt(w[name + "running_var"] + 1e-5) * w[name + "weight"] + w[name + "bias"]
            new.append(v + line(z * sig(z), at + "conv_module.sequential.5"))
        rows = [norm(v + ffn(v, "ffn2") / 2, at + "final_layer_norm") for v in new]
    for k in (0, 2):
        name = f"upsampling.deconv.{k}"
        out = [w[name + ".bias"].astype(float).copy() for _ in range(2 * len(rows) + 1)]
        for t, v in enumerate(rows):
            for j in range(3):
                out[2 * t + j] += w[name + ".weight"][:, :, j].T @ v
        rows = [np.maximum(0, v) for v in out]

    def lstm(seq, way):
        h = c = np.zeros(w["lstm.weight_hh_l0"].shape[1])
        out = []
        for v in seq:
            i, f, g, o = np.split(w[f"lstm.weight_ih_l0{way}"] @ v + w[f"lstm.weight_hh_l0{way}"] @ h + w[f"lstm.bias_ih_l0{way}"] + w[f"lstm.bias_hh_l0{way}"], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        return out

    both = [np.concatenate(p) for p in zip(lstm(rows, ""), lstm(rows[::-1], "_reverse")[::-1])]
    return np.array([sig(w["fc.weight"][0] @ v + w["fc.bias"][0]) for v in both])[: feat.shape[2]]


@pytest.mark.parametrize("frames", [12, 15])
def test_conformer_equals_a_plain_loop(frames):
    w = tiny(networks.breath_shapes(16, 8, 12, 2, 5, 6))
    feat = rng(3).standard_normal((3, 16, frames))
    assert networks.breath_chances(w, feat, 2) == pytest.approx(plain_breaths(w, feat, 2, 2), rel=1e-5, abs=1e-6)


def test_networks_on_chunks_equal_whole_files(spark, tmp_path):
    x = np.concatenate([phrase(2), room(0.3), phrase(2)])[: 2 * RATE]
    write(tmp_path / "a.wav", x)
    w = tiny(networks.breath_shapes(16, 8, 12, 1, 5, 6))
    cut = wav.chunks(spark, str(tmp_path), 40_000, 5.0)
    got = networks.breath_probabilities(cut, w, 2).orderBy("frame").toPandas()
    whole = wav.chunks(spark, str(tmp_path), 10**6, 5.0)
    want = networks.breath_probabilities(whole, w, 2).orderBy("frame").toPandas()
    assert list(got.frame) == list(want.frame) == list(range(len(x) * 100 // RATE + 1)) and got.error.isna().all()
    assert np.abs(got.p.to_numpy(float) - want.p.to_numpy(float)).max() < 1e-3
    t = tiny(networks.truncation_shapes(80, 8, 12, 1, 3))
    ends = spark.createDataFrame([(r.file, RATE, at, -10.0) for r in wav.files(spark, str(tmp_path)).collect() for at in (30_000, 40_000, 40_001)], "file string, sample_rate int, at long, peak_db double")
    for row in networks.score_clip_ends(cut, ends, t, 2).collect():
        y = np.round(x * 2**23) / 2**23
        assert row.score == pytest.approx(networks.truncation_score(t, y[: row.at], RATE, 2), rel=1e-4)


def test_filters_have_their_response():
    x = rng(4).standard_normal(RATE)
    for hz, gain in ((2000, 0), (16_500, -6.02), (19_000, 0)):
        y = kernels.filtered(tone(1, hz, 0), RATE, 8, low=16_500)
        level = 10 * np.log10(np.square(y[5000:-5000]).mean())
        assert level < -100 if hz == 2000 else abs(level - gain) < 0.1
    band = kernels.filtered(x, RATE, 4, 500, 8000, zero_phase=False)
    power = np.abs(np.fft.rfft(band)) ** 2 / np.abs(np.fft.rfft(x)) ** 2
    assert np.median(power[1000:7000]) == pytest.approx(1, abs=0.05) and np.median(power[16_000:]) < 1e-4
    # causal: nothing comes before the impulse
    impulse = np.zeros(4000)
    impulse[2000] = 1
    assert np.abs(kernels.filtered(impulse, RATE, 4, 500, 8000, zero_phase=False)[:2000]).max() < 1e-6


@pytest.mark.parametrize("rate", [11_025, 22_050, 44_100, 48_000])
def test_resampled_tones_stay_tones(rate):
    t16 = np.arange(16_000) / 16_000
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    for y in (kernels.to_16k(x, rate), kernels.torch_like_resampled(x, rate, 16_000)):
        assert len(y) == 16_000 and np.abs(y - np.sin(2 * np.pi * 440 * t16))[500:-500].max() < 3e-3
    high = np.sin(2 * np.pi * 9000 * np.arange(rate) / rate)
    if rate > 20_000:
        assert np.abs(kernels.to_16k(high, rate)[500:-500]).max() < 1e-3
    low = kernels.resampled(x, 1, 4)
    assert np.abs(low - np.sin(2 * np.pi * 440 * np.arange(len(low)) * 4 / rate))[50:-50].max() < 5e-3


def test_mels():
    hz = np.array([0, 200, 999, 1000, 1001, 4000, 8000.0])
    for slaney in (True, False):
        assert kernels.mel_to_hz(kernels.hz_to_mel(hz, slaney), slaney) == pytest.approx(hz, abs=1e-6)
    assert kernels.hz_to_mel(1000) == pytest.approx(15) and kernels.hz_to_mel(1000, False) == pytest.approx(999.99, abs=0.01)
    filters = kernels.mel_filters(16_000, 400, 128)
    assert filters.shape == (128, 201) and (filters >= 0).all() and kernels.mel_filters(16_000, 400, 80, slaney=False).max() <= 1
    y = 0.1 * np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    assert kernels.log_mel(y).shape == (98, 80)
    feat = kernels.breath_features(y, 128)
    assert feat.shape == (3, 128, 101) and feat[0].max() == 0 and feat[0].min() >= -80
    assert feat[2, 0, 50] == pytest.approx(2 * 1000 / 16_000, abs=0.01) and feat[1, 5, 50] == pytest.approx(feat[0, :, 50].var(ddof=1))


def test_breaths_are_graded_and_confirmed(spark):
    c = spark.createDataFrame([("f", RATE, 1000 * k, 1000 * k + 20_000, db, False) for k, db in ((1, -40.0), (2, -31.6), (3, -26.4), (4, -22.5))], "file string, sample_rate int, start long, stop long, loudness_db double, flagged boolean")
    near = spark.createDataFrame([("f", 1000, 21_000, 900, 9.0, 200, -15.0), ("f", 2000, 22_000, 1900, 9.0, 200, -30.0), ("f", 3000, 23_000, 2900, 9.0, 50, -10.0), ("f", 4000, 24_000, 3900, 7.0, 200, -10.0)], "file string, start long, stop long, at long, rise_db double, silence_ms int, click_db double")
    got = [(r.start, r.severity, r.problem) for r in breaths.breaths(c, near).orderBy("stop").collect()]
    assert got == [(900, 3, "mouth-click inhale"), (1900, 2, "small mouth-click inhale; noticeable breath"), (3000, 2, "loud breath"), (4000, 3, "very loud breath")]
    frames = spark.createDataFrame([("f", k, 0.9 if k < 12 else 0.1) for k in range(60)], "file string, frame long, p double")
    held = {r.start: r.held_ms for r in breaths.confirmed(c, frames).collect()}
    assert held == {1000: 100}


def test_a_click_before_a_breath_is_measured(spark, tmp_path):
    one = phrase()
    breath = kernels.filtered(rng(6).standard_normal(int(0.3 * RATE)), RATE, 4, 900, 3200) * 10 ** (-40 / 20)
    gap = room(1.5)
    at = int(0.7 * RATE)
    gap[at : at + len(breath)] += breath
    click = rng(7).standard_normal(130) * np.exp(-np.arange(130) / 26)
    gap[at - 1000 : at - 870] += click / np.abs(click).max() * 0.1
    x = np.concatenate([one, gap, phrase()])
    write(tmp_path / "a.wav", x)
    files, cut = wav.files(spark, str(tmp_path)), wav.chunks(spark, str(tmp_path), 50_000, breaths.MARGIN_S)
    levels = voice.narration(files, voice.speech_frames(cut))
    name, start = files.first().file, len(one) + at
    c = spark.createDataFrame([(name, RATE, start, start + len(breath), -35.0, False)], "file string, sample_rate int, start long, stop long, loudness_db double, flagged boolean")
    (row,) = breaths.clicks_near(cut, c, levels).collect()
    assert abs(row.at - (start - 1000)) < 0.004 * RATE and row.rise_db > 8 and 650 < row.silence_ms < 760 and -20 < row.click_db < 5
    (told,) = breaths.breaths(c, breaths.clicks_near(cut, c, levels)).collect()
    assert told.severity == 3 and told.problem == "mouth-click inhale" and told.start == row.at


@pytest.mark.parametrize("hole, ends, length, listed, found", [(0.06, 1, 20, False, 1), (0.04, 1, 20, False, 0), (0.09, 1, 20, False, 0), (0.06, 6, 20, False, 0), (0.06, 1, 4, False, 0), (0.06, 1, 20, True, 0)])
def test_breaths_cut_into_silence(spark, tmp_path, hole, ends, length, listed, found):
    x = np.concatenate([phrase(), room(0.5), np.zeros(int(hole * RATE)), phrase()])
    write(tmp_path / "a.wav", x)
    files, cut = wav.files(spark, str(tmp_path)), wav.chunks(spark, str(tmp_path))
    name, at = files.first().file, len(phrase()) + int(0.5 * RATE)
    last = at * 100 // RATE - ends
    frames = spark.createDataFrame([(name, k, 0.8 if last - length < k <= last and k != last - 2 else 0.1) for k in range(len(x) * 100 // RATE)], "file string, frame long, p double")
    known = spark.createDataFrame([(name, at - 12_000, at - 8000)] if listed else [], "file string, start long, stop long")
    got = breaths.breath_cuts(cut, files, frames, known).collect()
    assert len(got) == found and all(r.problem == "breath cut off into silence" and r.severity == 0 and r.duration_ms == 10 * length for r in got)
