"""Made-up narration for the checks of sound: voiced words, room noise and planted defects."""

import struct

import numpy as np

RATE = 44_100


def rng(seed=11):
    return np.random.default_rng(seed)


def word(seconds, pitch, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    phase = 2 * np.pi * np.cumsum(pitch + 25 * np.sin(2 * np.pi * t / max(seconds, 0.2))) / rate
    x = sum(np.sin(k * phase) / k for k in range(1, 14))
    fade = np.minimum(1, np.minimum(np.arange(len(t)), np.arange(len(t))[::-1]) / (0.015 * rate))
    return 0.25 * x / np.abs(x).max() * fade


def room(seconds, db=-72.0, rate=RATE, seed=5):
    return rng(seed + int(seconds * 1000)).standard_normal(int(seconds * rate)) * 10 ** (db / 20)


def phrase(words=4, rate=RATE):
    return np.concatenate([p for k in range(words) for p in (word(0.32 + 0.05 * (k % 3), 120 + 12 * (k % 4), rate), room(0.06, rate=rate, seed=k))])


def narration(seconds, rate=RATE):
    out = []
    while sum(map(len, out)) < seconds * rate:
        out += [phrase(4, rate), room(0.5, rate=rate, seed=len(out))]
    return np.concatenate(out)


def tone(seconds, hz, db, rate=RATE, fade=0.0):
    """A sine of that level (RMS)."""
    t = np.arange(int(seconds * rate)) / rate
    ramp = np.minimum(1, np.minimum(t, t[::-1]) / fade) if fade else 1
    return 10 ** (db / 20) * 2**0.5 * np.sin(2 * np.pi * hz * t) * ramp


def write(path, x, rate=RATE, bits=24, claimed=None):
    body = np.round(np.clip(x, -1, 1 - 2**-23) * 2**23).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    if bits == 8:
        body = (np.round(np.clip(x, -1, 0.99) * 127) + 128).astype(np.uint8).tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits)
    data = form + struct.pack("<4sI", b"data", len(body) if claimed is None else claimed) + body
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(data)) + b"WAVE" + data)
