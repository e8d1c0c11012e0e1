"""Two small networks over sound, in numpy inside tasks: a causal transformer that scores clip ends, a conformer that hears breaths.

Weights come as arrays by name (sources.weights) and are sent to the tasks once, up to MOST_BYTES. Shapes are checked against the tables below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedline.operators import kernels, voice

MOST_BYTES = 256 << 20
#: Seconds before a clip end that are read, length of the frames that decide (s); seconds of sound read at once for breaths, and of those kept.
TAIL_S, DECISION_S = 5.0, 0.01
BREATH_READ_S, BREATH_KEPT_S = 30, 20
THETA, RMS_EPS, NORM_EPS = 10_000.0, 1e-6, 1e-5


def collect_weights(tensors: DataFrame) -> dict[str, np.ndarray]:
    """The arrays of one weights file on the driver; refused beyond MOST_BYTES, or if the file has an error."""
    size = tensors.agg(F.sum(F.size("values")).alias("n")).first()["n"] or 0
    if 4 * size > MOST_BYTES:
        raise ValueError(f"weights of {4 * size} bytes are not sent to all tasks")
    rows = tensors.collect()
    if bad := [r.error for r in rows if r.error]:
        raise ValueError(bad[0])
    return {r.name: np.array(r["values"], np.float32).reshape(r["shape"]) for r in rows}


def loaded(tensors: DataFrame, shapes: dict[str, tuple[int, ...]]) -> tuple[dict[str, np.ndarray] | None, str]:
    """(weights, 'on'), or (None, 'off: why') where they can't be had or don't fit: a run goes on without the network and tells so."""
    try:
        return checked(collect_weights(tensors), shapes), "on"
    except ValueError as why:
        return None, f"off: {why}"


def checked(weights: dict[str, np.ndarray], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    wrong = {k: tuple(weights[k].shape) if k in weights else None for k in shapes if k not in weights or tuple(weights[k].shape) != shapes[k]}
    extra = sorted(set(weights) - set(shapes))
    if wrong or extra:
        raise ValueError(f"weights don't fit: missing or of another shape {sorted(wrong)[:3]}, unknown {extra[:3]}")
    return weights


# --- clip ends


def truncation_shapes(mels: int = 80, width: int = 384, inner: int = 888, layers: int = 8, vocabulary: int = 32, labels: int = 2) -> dict[str, tuple[int, ...]]:
    """Fixed names of the transformer's weights, and their shapes."""
    square, out = (width, width), {"backbone.embed_tokens.weight": (vocabulary, width), "backbone.norm.weight": (width,)}
    out |= {"input_projection.weight": (width, mels), "input_projection.bias": (width,), "classifier.weight": (labels, width), "classifier.bias": (labels,)}
    each = {f"self_attn.{x}_proj.weight": square for x in "qkvo"} | {f"{x}_layernorm.weight": (width,) for x in ("input", "post_attention")}
    each |= {"mlp.gate_proj.weight": (inner, width), "mlp.up_proj.weight": (inner, width), "mlp.down_proj.weight": (width, inner)}
    return out | {f"backbone.layers.{n}.{k}": v for n in range(layers) for k, v in each.items()}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, turn=None, causal: bool = False) -> np.ndarray:
    """Frames x width in, frames x width out; turn is applied to the queries and keys of each head; q may be the last frames only."""
    (n, width), total = q.shape, len(k)
    q, k, v = (x.reshape(len(x), heads, width // heads).transpose(1, 0, 2) for x in (q, k, v))
    if turn is not None:
        q, k = turn(q, total - n), turn(k, 0)
    scores = q @ k.transpose(0, 2, 1) / np.sqrt(width // heads)
    if causal:
        scores = np.where(np.arange(total) > np.arange(total - n, total)[:, None], -np.inf, scores)
    return (_softmax(scores) @ v).transpose(1, 0, 2).reshape(n, width)


def _turned(x: np.ndarray, first: int) -> np.ndarray:
    """Rotary places: each pair (i, i + half) of a head is turned by its place times a falling frequency."""
    half = x.shape[-1] // 2
    angle = np.arange(first, first + x.shape[1])[:, None] * THETA ** (-np.arange(half) / half)
    a, b, c, s = x[..., :half], x[..., half:], np.cos(angle), np.sin(angle)
    return np.concatenate([a * c - b * s, b * c + a * s], axis=-1)


def truncation_logits(w: dict[str, np.ndarray], mel: np.ndarray, heads: int, last: int | None = None) -> np.ndarray:
    """Frames x labels of one window (frames x mels); with `last`, of its last frames only, which is all that the last layer computes then."""

    def scaled(x, name):
        return x / np.sqrt(np.mean(np.square(x), axis=-1, keepdims=True) + RMS_EPS) * w[name]

    h = mel @ w["input_projection.weight"].T + w["input_projection.bias"]
    layers = sum(name.endswith("q_proj.weight") for name in w)
    for n in range(layers):
        at = f"backbone.layers.{n}."
        x = scaled(h, at + "input_layernorm.weight")
        q, k, v = (x @ w[f"{at}self_attn.{c}_proj.weight"].T for c in "qkv")
        if last and n == layers - 1:
            q, h = q[-last:], h[-last:]
        h = h + _attention(q, k, v, heads, _turned, True) @ w[at + "self_attn.o_proj.weight"].T
        x = scaled(h, at + "post_attention_layernorm.weight")
        gate = x @ w[at + "mlp.gate_proj.weight"].T
        h = h + gate * _logistic(gate) * (x @ w[at + "mlp.up_proj.weight"].T) @ w[at + "mlp.down_proj.weight"].T
    return scaled(h, "backbone.norm.weight") @ w["classifier.weight"].T + w["classifier.bias"]


def truncation_score(w: dict[str, np.ndarray], x: np.ndarray, rate: int, heads: int) -> float:
    """How surely the sound x is cut at its end: the greatest chance of label 1 over the deciding frames of its last 5 s (zeros before it, if shorter)."""
    keep = int(TAIL_S * 16_000)
    y = kernels.torch_like_resampled(np.asarray(x, np.float64), rate, 16_000)[-keep:]
    y = np.concatenate([np.zeros(keep - len(y)), y])
    frames = max(1, int(np.ceil(DECISION_S / 0.01)))
    return float(_softmax(truncation_logits(w, kernels.log_mel(y)[:, : w["input_projection.weight"].shape[1]], heads, frames))[:, 1].max())


def score_clip_ends(cut: DataFrame, ends: DataFrame, weights: dict[str, np.ndarray], heads: int = 8) -> DataFrame:
    """ends (defects.clip_ends) with score. Chunks need TAIL_S of margin; an end's sound comes from the chunk that holds its last sample."""
    sent = cut.sparkSession.sparkContext.broadcast(weights)
    marks = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "peak_db"))).alias("ends"))  # a few a file

    def find(batches):
        for row in voice.rows(batches):
            own = [e for e in row.ends if row.start < e["at"] <= row.core_stop]
            tails = [np.asarray(row.samples)[max(0, e["at"] - row.window_start - int(TAIL_S * row.sample_rate)) : e["at"] - row.window_start] for e in own]
            scores = [truncation_score(sent.value, x, row.sample_rate, heads) for x in tails]
            yield pd.DataFrame({"file": row.file, "sample_rate": row.sample_rate, "at": np.array([e["at"] for e in own], np.int64), "peak_db": np.array([e["peak_db"] for e in own], float), "score": np.array(scores, float)})

    return cut.join(marks, "file").mapInPandas(find, "file string, sample_rate int, at long, peak_db double, score double")


# --- breaths


def breath_shapes(mels: int = 128, width: int = 128, inner: int = 256, layers: int = 8, kernel: int = 31, lstm: int = 256) -> dict[str, tuple[int, ...]]:
    """Fixed names of the conformer's weights, and their shapes."""
    less = ((mels - 3) // 2 + 1 - 3) // 2 + 1
    out: dict[str, tuple[int, ...]] = {}

    def both(name, *shape, bias=None):
        out.update({f"{name}.weight": shape, f"{name}.bias": (bias or shape[0],)})

    both("downsampling.conv1.0", 1, 3, 3, 3)
    both("downsampling.conv2.0", 1, 1, 3, 3)
    both("linear", width, less)
    both("fc", 1, 2 * lstm)
    for k in (0, 2):
        both(f"upsampling.deconv.{k}", width, width, 3)
    for way in ("", "_reverse"):
        out |= {f"lstm.weight_ih_l0{way}": (4 * lstm, width), f"lstm.weight_hh_l0{way}": (4 * lstm, lstm), f"lstm.bias_ih_l0{way}": (4 * lstm,), f"lstm.bias_hh_l0{way}": (4 * lstm,)}
    for n in range(layers):
        at = f"conformer.conformer_layers.{n}."
        for part in ("ffn1.sequential.0", "ffn2.sequential.0", "self_attn_layer_norm", "conv_module.layer_norm", "conv_module.sequential.3", "final_layer_norm"):
            both(at + part, width)
        for part in ("ffn1", "ffn2"):
            both(f"{at}{part}.sequential.1", inner, width)
            both(f"{at}{part}.sequential.4", width, inner)
        out |= {f"{at}self_attn.in_proj_weight": (3 * width, width), f"{at}self_attn.in_proj_bias": (3 * width,)}
        both(f"{at}self_attn.out_proj", width, width)
        both(f"{at}conv_module.sequential.0", 2 * width, width, 1)
        both(f"{at}conv_module.sequential.2", width, 1, kernel)
        both(f"{at}conv_module.sequential.5", width, width, 1)
        out |= {f"{at}conv_module.sequential.3.running_{x}": (width,) for x in ("mean", "var")}
    return out


def _halved(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 3 x 3 convolution at every second place of channels x bands x frames (frames made odd with zeros), without negative values."""
    if x.shape[2] % 2 == 0:
        x = np.pad(x, [(0, 0), (0, 0), (0, 1)])
    near = np.lib.stride_tricks.sliding_window_view(x, (3, 3), axis=(1, 2))[:, ::2, ::2]
    return np.maximum(np.tensordot(w, near, axes=([1, 2, 3], [0, 3, 4])) + b[:, None, None], 0)


def _doubled(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A transposed convolution of three taps at twice the frames (frames x channels), without negative values."""
    out = np.tile(b, (2 * len(x) + 1, 1)).astype(float)
    for k in range(3):
        out[k : k + 2 * len(x) - 1 : 2] += x @ w[:, :, k]
    return np.maximum(out, 0)


def _recurrent(x: np.ndarray, w: dict[str, np.ndarray], way: str) -> np.ndarray:
    """One direction of an LSTM (gates in, forget, cell, out)."""
    into, again = w[f"lstm.weight_ih_l0{way}"], w[f"lstm.weight_hh_l0{way}"].T
    drive = x @ into.T + w[f"lstm.bias_ih_l0{way}"] + w[f"lstm.bias_hh_l0{way}"]
    size = len(again)
    state, cell, out = np.zeros(size), np.zeros(size), np.empty((len(x), size))
    for t, now in enumerate(drive):
        gates = now + state @ again
        keep = _logistic(gates)
        cell = keep[size : 2 * size] * cell + keep[:size] * np.tanh(gates[2 * size : 3 * size])
        state = keep[3 * size :] * np.tanh(cell)
        out[t] = state
    return out


def _conformer(w: dict[str, np.ndarray], at: str, x: np.ndarray, heads: int) -> np.ndarray:
    def affine(z, name):
        return z @ w[f"{at}{name}.weight"].reshape(w[f"{at}{name}.weight"].shape[:2]).T + w[f"{at}{name}.bias"]

    def norm(z, name):
        z = z - z.mean(axis=-1, keepdims=True)
        return z / np.sqrt(np.square(z).mean(axis=-1, keepdims=True) + NORM_EPS) * w[f"{at}{name}.weight"] + w[f"{at}{name}.bias"]

    def forward(z, name):
        z = affine(norm(z, f"{name}.sequential.0"), f"{name}.sequential.1")
        return affine(z * _logistic(z), f"{name}.sequential.4")

    x = x + forward(x, "ffn1") / 2
    q, k, v = np.split(norm(x, "self_attn_layer_norm") @ w[at + "self_attn.in_proj_weight"].T + w[at + "self_attn.in_proj_bias"], 3, axis=1)
    x = x + affine(_attention(q, k, v, heads), "self_attn.out_proj")
    a, b = np.split(affine(norm(x, "conv_module.layer_norm"), "conv_module.sequential.0"), 2, axis=1)
    taps = w[at + "conv_module.sequential.2.weight"][:, 0]
    half = (taps.shape[1] - 1) // 2
    near = np.lib.stride_tricks.sliding_window_view(np.pad(a * _logistic(b), [(half, half), (0, 0)]), taps.shape[1], axis=0)
    z = np.einsum("tck,ck->tc", near, taps) + w[at + "conv_module.sequential.2.bias"]
    name = at + "conv_module.sequential.3."
    z = (z - w[name + "running_mean"]) / np.sqrt(w[name + "running_var"] + NORM_EPS) * w[name + "weight"] + w[name + "bias"]
    x = x + affine(z * _logistic(z), "conv_module.sequential.5")
    return norm(x + forward(x, "ffn2") / 2, "final_layer_norm")


def breath_chances(w: dict[str, np.ndarray], features: np.ndarray, heads: int) -> np.ndarray:
    """The chance of a breath in each frame, from features of 3 x bands x frames."""
    x = _halved(_halved(features, w["downsampling.conv1.0.weight"], w["downsampling.conv1.0.bias"]), w["downsampling.conv2.0.weight"], w["downsampling.conv2.0.bias"])
    x = x[0].T @ w["linear.weight"].T + w["linear.bias"]
    for n in range(sum(name.endswith("in_proj_weight") for name in w)):
        x = _conformer(w, f"conformer.conformer_layers.{n}.", x, heads)
    for k in (0, 2):
        x = _doubled(x, w[f"upsampling.deconv.{k}.weight"], w[f"upsampling.deconv.{k}.bias"])
    both = np.concatenate([_recurrent(x, w, ""), _recurrent(x[::-1], w, "_reverse")[::-1]], axis=1)
    return _logistic(both @ w["fc.weight"][0] + w["fc.bias"][0])[: features.shape[2]]


def breath_probabilities(cut: DataFrame, weights: dict[str, np.ndarray], heads: int = 4) -> DataFrame:
    """file, frame, p, error: the chance of a breath every 10 ms, frame k being at k * 10 ms.

    Chunks should have BREATH_KEPT_S seconds, and a margin of (BREATH_READ_S - BREATH_KEPT_S) / 2. A chunk that the network fails on gives one row with the error.
    """
    sent = cut.sparkSession.sparkContext.broadcast(weights)
    bands = 4 * (weights["linear.weight"].shape[1] + 1)  # as many as reduce to that; see breath_shapes

    def find(batches):
        w = sent.value
        for row in voice.rows(batches):
            rate = row.sample_rate
            per = 100 // int(np.gcd(rate, 100))  # frames to a whole number of samples
            step = rate * per // 100
            first = -(-row.window_start // step)
            try:
                y = kernels.to_16k(np.asarray(row.samples, np.float64)[first * step - row.window_start :], rate)
                n = 1 + len(y) // 160
                y = np.concatenate([y, np.zeros(max(0, 480 - len(y)))])
                p = breath_chances(w, kernels.breath_features(y, bands), heads)[:n]
            except (ValueError, IndexError, FloatingPointError) as why:
                yield pd.DataFrame({"file": [row.file], "frame": [None], "p": [None], "error": [str(why)]}).astype({"frame": "Int64", "p": float})
                continue
            at = np.arange(len(p)) + first * per
            last = np.inf if row.core_stop == row.n_samples else row.core_stop
            own = (at * rate >= row.start * 100) & (at * rate < last * 100)
            yield pd.DataFrame({"file": row.file, "frame": at[own], "p": p[own], "error": None}).astype({"frame": "Int64", "error": object})

    return cut.mapInPandas(find, "file string, frame long, p double, error string")
