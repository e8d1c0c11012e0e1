"""Numpy kernels on one stretch of sound: filters, short spectra and resampling. The checks run them on chunks with margins.

Filters are applied as their frequency response, so nothing runs sample by sample; what wraps around at the ends of a stretch must be margin.
"""

from __future__ import annotations

import numpy as np

FLOOR = 1e-20


def db(power: np.ndarray) -> np.ndarray:
    """Decibels of a mean square."""
    return 10 * np.log10(np.maximum(power, FLOOR))


def _warped(rate: float, hz) -> np.ndarray:
    """The analog frequency that the bilinear transform takes a frequency to."""
    return np.tan(np.pi * np.asarray(hz, np.float64) / rate)


def butterworth(freqs: np.ndarray, rate: float, order: int, low: float | None, high: float | None) -> np.ndarray:
    """Complex response of a digital Butterworth filter: high-pass from low, low-pass to high, or both as one band-pass."""
    at = _warped(rate, np.clip(freqs, 1e-9, rate / 2 * (1 - 1e-9)))
    if low is None:
        s = 1j * at / _warped(rate, high)
    elif high is None:
        s = -1j * _warped(rate, low) / at
    else:
        a, b = _warped(rate, low), _warped(rate, high)
        s = 1j * (at * at - a * b) / (at * (b - a))
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    out = np.ones(len(at), complex)
    for pole in poles:
        out /= s - pole
    return out


def filtered(x: np.ndarray, rate: float, order: int, low: float | None = None, high: float | None = None, zero_phase: bool = True) -> np.ndarray:
    """x through a Butterworth filter: once, or forwards and backwards without delay. The stretch is padded with its mirror image."""
    pad = min(len(x) - 1, 8192)
    if pad < 1:
        return np.zeros(len(x))
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if zero_phase else np.concatenate([x, np.zeros(pad)])
    response = butterworth(np.fft.rfftfreq(len(long), 1 / rate), rate, order, low, high)
    out = np.fft.irfft(np.fft.rfft(long) * (np.abs(response) ** 2 if zero_phase else response), len(long))
    return out[pad : pad + len(x)] if zero_phase else out[: len(x)]


def kaiser_sinc(taps: int, cutoff: float, beta: float) -> np.ndarray:
    """Low-pass of unit sum; cutoff as a part of half the rate."""
    at = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * at) * np.kaiser(taps, beta)
    return h / h.sum()


def resampled(x: np.ndarray, up: int, down: int, crossings: int = 10, beta: float = 5.0, edge: float = 1.0) -> np.ndarray:
    """x at up / down times its rate through a Kaiser-windowed sinc of so many zero crossings a side, cut off at `edge` of the lower half rate; output k lies at input k * down / up."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return np.asarray(x, np.float64).copy()
    half = crossings * max(up, down)
    h = up * kaiser_sinc(2 * half + 1, edge / max(up, down), beta)
    count = -(-len(x) * up // down)
    at = np.arange(count) * down  # places on the grid of up times the rate
    first = -(-(at - half) // up)
    width = 2 * half // up + 1
    out = np.empty(count)
    for a in range(0, count, 65_536):
        base = first[a : a + 65_536, None] + np.arange(width)
        tap = at[a : a + 65_536, None] - base * up + half
        inside = (base >= 0) & (base < len(x)) & (tap >= 0) & (tap <= 2 * half)
        out[a : a + 65_536] = np.where(inside, x[np.clip(base, 0, len(x) - 1)] * h[np.clip(tap, 0, 2 * half)], 0).sum(axis=1)
    return out


def torch_like_resampled(x: np.ndarray, rate: int, to: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """x at another rate by a Hann-windowed sinc of `width` zero crossings below `rolloff` of the lower rate; as many samples as that rate gives, rounded up."""
    g = int(np.gcd(rate, to))
    old, new = rate // g, to // g
    if old == new:
        return np.asarray(x, np.float64).copy()
    base = min(old, new) * rolloff
    count = int(np.ceil(np.float32(new * len(x) / old)))
    reach = int(np.ceil(width * old / base))
    at = np.arange(count) * old / new
    out = np.empty(count)
    for a in range(0, count, 65_536):
        near = np.floor(at[a : a + 65_536]).astype(np.int64)[:, None] + np.arange(-reach, reach + 2)
        t = np.clip((near - at[a : a + 65_536, None]) / old * base, -width, width)
        h = np.sinc(t) * np.cos(t * np.pi / width / 2) ** 2 * base / old
        inside = (near >= 0) & (near < len(x))
        out[a : a + 65_536] = (np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0) * h).sum(axis=1)
    return out


def frames(x: np.ndarray, size: int, hop: int, first: int, count: int) -> np.ndarray:
    """`count` frames of `size`, the k-th from first + k * hop on; what lies outside x is 0."""
    at = first + np.arange(count)[:, None] * hop + np.arange(size)
    inside = (at >= 0) & (at < len(x))
    return np.where(inside, x[np.clip(at, 0, len(x) - 1)], 0.0) if len(x) else np.zeros((count, size))


def surroundings(values: np.ndarray, at: np.ndarray, low: int, high: int, outside: float) -> np.ndarray:
    """A row for each place: values from low to before high places on from it, `outside` where there are none."""
    return np.pad(values, (max(0, -low), max(0, high)), constant_values=outside)[at[:, None] + max(0, -low) + np.arange(low, high)] if high > low else np.empty((len(at), 0))


def band_sums(power: np.ndarray, freqs: np.ndarray, edges: list[tuple[float, float]]) -> np.ndarray:
    """Sums of spectra over bands (from the first edge on, below the second)."""
    masks = np.stack([(freqs >= a) & (freqs < b) for a, b in edges], axis=1).astype(np.float64)
    return power @ masks


def half_octaves(rate: int, low: float, high: float) -> list[tuple[float, float]]:
    top = min(high, 0.95 * rate / 2) + 1e-6
    count = int(np.floor(2 * np.log2(top / low) + 1e-9)) if top > low else 0
    return [(low * 2 ** (k / 2), low * 2 ** ((k + 1) / 2)) for k in range(count)]


def sliding_max(x: np.ndarray, size: int) -> np.ndarray:
    """Greatest value of the odd `size` rows around each row, edge rows repeated."""
    half = size // 2
    wide = np.concatenate([np.repeat(x[:1], half, axis=0), x, np.repeat(x[-1:], half, axis=0)])
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=0).max(axis=-1)


def sliding_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of `size` rows around each row (size // 2 of them before), edge rows repeated."""
    before = size // 2
    wide = np.concatenate([np.repeat(x[:1], before, axis=0), x, np.repeat(x[-1:], size - 1 - before, axis=0)])
    sums = np.cumsum(np.concatenate([np.zeros_like(wide[:1]), wide]), axis=0)
    return (sums[size:] - sums[:-size]) / size


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of `size` rows around each row (size // 2 of them before), edge rows repeated."""
    before = size // 2
    wide = np.concatenate([np.repeat(x[:1], before, axis=0), x, np.repeat(x[-1:], size - 1 - before, axis=0)])
    return np.lib.stride_tricks.sliding_window_view(wide, size, axis=0).min(axis=-1)


def hz_to_mel(hz, slaney: bool = True) -> np.ndarray:
    """Slaney: linear to 1000 Hz (15 mels), logarithmic beyond; else the HTK formula."""
    hz = np.asarray(hz, np.float64)
    if not slaney:
        return 2595 * np.log10(1 + hz / 700)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def mel_to_hz(mel, slaney: bool = True) -> np.ndarray:
    mel = np.asarray(mel, np.float64)
    if not slaney:
        return 700 * (10 ** (mel / 2595) - 1)
    return np.where(mel < 15, 200 * mel / 3, 1000 * np.exp((np.maximum(mel, 15) - 15) * np.log(6.4) / 27))


def mel_filters(rate: int, size: int, bands: int, low: float = 0.0, high: float | None = None, slaney: bool = True) -> np.ndarray:
    """Triangles evenly spaced in mels over the bins of a spectrum of `size`: bands x bins. Slaney's are scaled to equal areas."""
    hz = mel_to_hz(np.linspace(hz_to_mel(low, slaney), hz_to_mel(high or rate / 2, slaney), bands + 2), slaney)
    bins = np.fft.rfftfreq(size, 1 / rate)
    left, mid, right = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    shape = np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)))
    return shape * (2 / (right - left)) if slaney else shape


def log_mel(y: np.ndarray) -> np.ndarray:
    """Log-mel frames of sound at 16 kHz: 400 samples every 160, periodic Hamming window, 80 HTK bands, (ln(max(power, 1e-5)) + 4) / 4."""
    count = max(0, (len(y) - 400) // 160 + 1)
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(400) / 400)
    power = np.abs(np.fft.rfft(frames(y, 400, 160, 0, count) * window, axis=1)) ** 2
    return (np.log(np.maximum(power @ mel_filters(16_000, 400, 80, slaney=False).T, 1e-5)) + 4) / 4


def to_16k(x: np.ndarray, rate: int) -> np.ndarray:
    """Sound at 16 kHz through a long sharp filter: up to 64 zero crossings, fewer where the rates share few factors."""
    reach = max(16_000, rate) // int(np.gcd(16_000, rate))
    return resampled(x, 16_000, rate, int(np.clip(4_000_000 // (2 * reach), 8, 64)), 8.0, 0.96)


def breath_features(y: np.ndarray, bands: int = 128) -> np.ndarray:
    """Of sound at 16 kHz, a frame every 160 samples (centred there): mel decibels (0 at the loudest, -80 at least), their variance over bands, and zero crossings. 3 x bands x frames."""
    count = 1 + len(y) // 160
    parts = frames(y, 400, 160, -200, count)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    mel = np.abs(np.fft.rfft(parts * window, axis=1)) ** 2 @ mel_filters(16_000, 400, bands).T
    level = 10 * np.log10(np.maximum(mel, 1e-10)) - 10 * np.log10(max(mel.max(initial=0), 1e-10))
    level = np.maximum(level, level.max() - 80)
    crossings = np.abs(np.diff(np.sign(parts), axis=1)).sum(axis=1) / 800
    return np.stack([level.T, np.tile(level.var(axis=1, ddof=1), (bands, 1)), np.tile(crossings, (bands, 1))])
