"""NumPy kernels for what isn't a composition of relational operators: alignment and compression."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scale of the cepstral distance in decibels.
MCD_SCALE = 10.0 / np.log(10.0) * np.sqrt(2.0)
#: Cells of a warp table whose steps are held at once.
STEPS = 1 << 24


def edit_distance(a: list, b: list) -> int:
    """Least insertions, deletions and substitutions that turn a into b, row by row of the table."""
    if not a or not b:
        return max(len(a), len(b))
    codes: dict = {}
    left = np.array([codes.setdefault(t, len(codes)) for t in a])
    right = np.array([codes.setdefault(t, len(codes)) for t in b])
    place = np.arange(len(right) + 1)
    row = place.copy()
    for k, t in enumerate(left, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (right != t))
        # insertions run along the row: the least of what came before plus the distance
        row = np.minimum.accumulate(np.r_[k, best] - place) + place
    return int(row[-1])


def warp_path(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone path of |x_i - y_j| from (0, 0) to the ends; of equal steps the diagonal, then x, then y.

    Costs are kept of two anti-diagonals, and of two at the start of each block of them. The steps, a byte per cell, are
    held of one block at a time and worked out again on the way back, so that series of 50,000 frames take about
    140 MB; a table of up to STEPS cells is one block.
    """
    n, m = len(x), len(y)
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if not n or not m:
        return []
    whole = n + m - 1
    span = whole if whole * (n + 1) <= STEPS else max(1, int(4 * np.sqrt(whole)))

    def moved(d: int, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        ways = np.stack([before[i - 1], last[i - 1], last[i]])
        best = np.argmin(ways, axis=0)
        now = np.full(n + 1, np.inf)
        now[i] = np.abs(x[i - 1] - y[d - i - 1]) + ways[best, np.arange(len(i))]
        return i, best, now

    # by i: the costs of the cells (i, d - i) of the last two anti-diagonals
    last, before = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    before[0] = 0.0
    starts = list(range(2, n + m + 1, span))
    kept = [(last, before)]
    for d in range(2, starts[-1]):
        last, before = moved(d, last, before)[2], last
        if d + 1 == starts[len(kept)]:
            kept.append((last, before))
            if len(kept) == len(starts):
                break
    step = np.zeros((span, n + 1), dtype=np.uint8)
    i, j, path = n, m, []
    for first, (last, before) in zip(starts[::-1], kept[::-1], strict=True):
        for d in range(first, min(first + span, i + j + 1)):
            at, best, now = moved(d, last, before)
            step[d - first, at] = best
            last, before = now, last
        while i and j and i + j >= first:
            path.append((i - 1, j - 1))
            way = step[i + j - first, i]
            i, j = (i - 1, j - 1) if way == 0 else (i - 1, j) if way == 1 else (i, j - 1)
    return path[::-1]


def cepstral_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of two coefficient sequences (frames, coefficients) along the warp path of the first coefficient."""
    if not len(a) or not len(b):
        return float("nan")
    path = np.array(warp_path(a[:, 0], b[:, 0]))
    gap = a[path[:, 0]] - b[path[:, 1]]
    return float(MCD_SCALE * np.mean(np.sqrt((gap * gap).sum(axis=1))))


@F.pandas_udf(T.IntegerType())
def token_errors(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance of two token arrays."""
    return pd.Series([edit_distance(list(a), list(b)) for a, b in zip(reference, hypothesis, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes over deflated bytes; 1 for the empty text."""
    packed = [t.encode() for t in text.fillna("")]
    return pd.Series([len(b) / max(1, len(zlib.compress(b))) if b else 1.0 for b in packed])


def power_frames(samples: np.ndarray, size: int = 512, hop: int = 160) -> np.ndarray:
    """Power spectrum (frames, size // 2 + 1) of centred, Hann-windowed frames."""
    padded = np.pad(np.asarray(samples, dtype=np.float64), size // 2)
    n = max(0, (len(padded) - size) // hop + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    cut = padded[np.arange(n)[:, None] * hop + np.arange(size)]
    return np.abs(np.fft.rfft(cut * window, axis=1)) ** 2


def spectral_denoise(samples: np.ndarray, size: int = 512, hop: int = 128, noise_frames: int = 10, alpha: float = 2.0, beta: float = 0.02) -> np.ndarray:
    """Samples whose spectral magnitudes are less alpha times those of the first frames, beta of them at least; phases stay."""
    n = len(samples)
    if n < size:
        return np.asarray(samples, dtype=np.float64)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(np.asarray(samples, dtype=np.float64), (size // 2, size))
    at = np.arange(0, len(padded) - size + 1, hop)[:, None] + np.arange(size)
    spectra = np.fft.rfft(padded[at] * window, axis=1)
    level = np.abs(spectra)
    noise = np.sqrt(np.mean(level[:noise_frames] ** 2, axis=0))
    clean = np.fft.irfft(np.maximum(level - alpha * noise, beta * level) * np.exp(1j * np.angle(spectra)), size, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    np.add.at(out, at, clean)
    np.add.at(weight, at, np.broadcast_to(window**2, at.shape))
    return (out / np.maximum(weight, 1e-8))[size // 2 : size // 2 + n]


def triangles(filters: int, size: int, rate: int) -> np.ndarray:
    """Linear triangular filters (filters, size // 2 + 1) between 0 and half the rate."""
    edge = np.floor((size + 1) * np.linspace(0, rate / 2, filters + 2) / rate).astype(int)
    low, mid, high = edge[:-2], edge[1:-1].copy(), edge[2:].copy()
    mid = np.where(mid == low, low + 1, mid)
    high = np.where(high == mid, mid + 1, high)
    bin_ = np.arange(size // 2 + 1)
    rise = (bin_ - low[:, None]) / np.maximum(mid - low, 1)[:, None]
    fall = (high[:, None] - bin_) / np.maximum(high - mid, 1)[:, None]
    inside = (bin_ >= low[:, None]) & (bin_ < high[:, None])
    return np.where(inside, np.where(bin_ < mid[:, None], rise, fall), 0.0)


def cosine_transform(rows: np.ndarray, keep: int) -> np.ndarray:
    """The first coefficients of the orthonormal DCT-II along the last axis."""
    n = rows.shape[-1]
    base = np.cos(np.pi * np.arange(keep)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    base[0] /= np.sqrt(2)
    return rows @ base.T


def linear_cepstra(samples: np.ndarray, rate: int = 16000, size: int = 512, hop: int = 160, filters: int = 40, keep: int = 20) -> np.ndarray:
    """Cepstra (frames, keep) of the log energies in linear filters."""
    energy = power_frames(samples, size, hop) @ triangles(filters, size, rate).T
    return cosine_transform(np.log(np.maximum(energy, 1e-10)), keep)


def _mel(hertz: np.ndarray | float) -> np.ndarray:
    """The mel scale that is linear to 1000 Hz and logarithmic above."""
    hertz = np.asarray(hertz, dtype=np.float64)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) * 27 / np.log(6.4))


def _hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_triangles(filters: int = 80, size: int = 512, rate: int = 16000) -> np.ndarray:
    """Triangular filters (filters, size // 2 + 1) of equal area whose corners are evenly spaced in mel."""
    corners = _hertz(np.linspace(_mel(0.0), _mel(rate / 2), filters + 2))
    at = np.arange(size // 2 + 1) * rate / size
    rise = (at - corners[:-2, None]) / (corners[1:-1] - corners[:-2])[:, None]
    fall = (corners[2:, None] - at) / (corners[2:] - corners[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall)) * (2 / (corners[2:] - corners[:-2]))[:, None]


def log_mel(samples: np.ndarray, rate: int = 16000, size: int = 512, hop: int = 160, filters: int = 80) -> np.ndarray:
    """Decibels (frames, filters) of the mel spectrum below its largest value, at most 80 below."""
    power = np.maximum(power_frames(samples, size, hop) @ mel_triangles(filters, size, rate).T, 1e-10)
    level = 10 * np.log10(power)
    return np.maximum(level - level.max(initial=-np.inf), -80.0)


def with_slopes(rows: np.ndarray, width: int = 4) -> np.ndarray:
    """Rows (frames, n) with their slopes and bends beside them, each column at mean 0 and deviation 1."""
    size = 2 * width + 1
    if len(rows) < size:
        raise ValueError(f"{size} frames are needed")
    x = np.arange(size) - width
    line = np.linalg.lstsq(np.vander(x, 2, increasing=True), np.eye(size), rcond=None)[0][1]
    bend = 2 * np.linalg.lstsq(np.vander(x, 3, increasing=True), np.eye(size), rcond=None)[0][2]
    base = np.clip(np.arange(len(rows)) - width, 0, len(rows) - size)
    cut = rows[base[:, None] + np.arange(size)]
    both = np.concatenate([rows, np.einsum("fkn,k->fn", cut, line), np.einsum("fkn,k->fn", cut, bend)], axis=1)
    return (both - both.mean(axis=0)) / (both.std(axis=0) + 1e-6)


def mel_features(samples: np.ndarray, rate: int = 16000) -> np.ndarray:
    """(frames, 119): 80 mel levels, 13 cepstra of them, and these cepstra's slopes and bends, normalised."""
    levels = log_mel(samples, rate)
    cepstra = with_slopes(cosine_transform(levels, 13))
    return np.concatenate([(levels - levels.mean(axis=0)) / (levels.std(axis=0) + 1e-6), cepstra], axis=1)


def linear_features(samples: np.ndarray, rate: int = 16000) -> np.ndarray:
    """(frames, 60): 20 linear cepstra with their slopes and bends, normalised."""
    return with_slopes(linear_cepstra(samples, rate))


def constant_q(samples: np.ndarray, rate: int = 16000, hop: int = 256, bins: int = 84, per_octave: int = 12, low: float = 32.7032) -> np.ndarray:
    """Magnitudes (frames, bins) at frequencies a constant ratio apart, each from windows of the same number of periods around a
    frame; a sine has half its amplitude."""
    pitch = low * 2.0 ** (np.arange(bins) / per_octave)
    if pitch[-1] >= rate / 2:
        raise ValueError("the highest frequency is above half the rate")
    samples = np.asarray(samples, dtype=np.float64)
    periods, frames = 1 / (2 ** (1 / per_octave) - 1), 1 + len(samples) // hop
    out = np.zeros((frames, bins))
    for k, hertz in enumerate(pitch):
        half = int(np.ceil(periods * rate / hertz / 2))
        at = np.arange(-half, half)
        wave = (0.5 + 0.5 * np.cos(np.pi * at / half)) * np.exp(-2j * np.pi * hertz * at / rate) / half
        around = np.lib.stride_tricks.sliding_window_view(np.pad(samples, (half, half + hop)), 2 * half)[::hop]
        for start in range(0, frames, 1024):
            out[start : start + 1024, k] = np.abs(around[start : min(start + 1024, frames)] @ wave)
    return out


def constant_q_features(samples: np.ndarray, rate: int = 16000) -> np.ndarray:
    """(frames, 60): 20 cepstra of constant-Q magnitudes with their slopes and bends, normalised."""
    return with_slopes(cosine_transform(np.log(np.maximum(constant_q(samples, rate), 1e-10)), 20))


def pitch_track(
    samples: np.ndarray, rate: int = 22050, size: int = 1024, hop: int = 256, low: float = 65.4064, high: float = 2093.0045, threshold: float = 0.1, quiet: float = 0.2
) -> tuple[np.ndarray, np.ndarray]:
    """(hertz, root mean square) of centred frames by the YIN method; hertz is 0 where a frame is not above `quiet` of the median level.

    The lag is the first local minimum of the normalised difference below the threshold, else the least of all, moved to the vertex of the
    parabola through its neighbours. Frames are taken 1,024 at a time.
    """
    half, first = size // 2, max(1, int(rate / high))
    last = min(int(np.ceil(rate / low)), size - half - 1)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(samples, dtype=np.float64), (half, half + hop)), size)[::hop]
    frames = frames[: 1 + len(samples) // hop]
    hertz, level = np.zeros(len(frames)), np.zeros(len(frames))
    for start in range(0, len(frames), 1024):
        part = frames[start : start + 1024]
        level[start : start + 1024] = np.sqrt(np.mean(part * part, axis=1))
        gap = np.stack([((part[:, :half] - part[:, lag : lag + half]) ** 2).sum(axis=1) for lag in range(1, last + 2)], axis=1)
        gap *= np.arange(1, last + 2) / np.maximum(np.cumsum(gap, axis=1), 1e-12)
        here, before, after = (gap[:, first - 1 + s : last + s] for s in (0, -1, 1)) if first > 1 else (gap[:, 1:-1], gap[:, :-2], gap[:, 2:])
        dip = (here < threshold) & (here < before) & (here <= after)
        best = np.where(dip.any(axis=1), dip.argmax(axis=1), here.argmin(axis=1))
        row = np.arange(len(part))
        a, b, c = before[row, best], here[row, best], after[row, best]
        bend = a - 2 * b + c
        shift = np.where(np.abs(bend) > 1e-12, (a - c) / (2 * np.where(bend == 0, 1.0, bend)), 0.0)
        hertz[start : start + 1024] = rate / (max(first, 2) + best + np.clip(shift, -1, 1))
    return np.where(level > quiet * np.median(level) if len(level) else False, hertz, 0.0), level


def _window(size: int, width: int) -> np.ndarray:
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    return np.pad(hann, ((size - width) // 2, size - width - (size - width) // 2))


def waveform(power: np.ndarray, rate: int = 16000, size: int = 512, hop: int = 160, width: int | None = None, steps: int = 16, seed: int = 0) -> np.ndarray:
    """Samples whose mel power spectrum is near `power` (frames, filters); phases by accelerated Griffin-Lim from seeded random ones."""
    power = np.maximum(np.asarray(power, dtype=np.float64), 0.0)
    if not len(power):
        return np.zeros(0)
    bank = mel_triangles(power.shape[1], size, rate)
    bins = np.maximum(power @ np.linalg.pinv(bank).T, power @ bank * 1e-3 + 1e-12)
    for _ in range(32):  # multiplicative steps to the least squares without negative power
        bins *= (power @ bank) / (bins @ bank.T @ bank + 1e-12)
    level, window = np.sqrt(bins), _window(size, width or size)
    at = np.arange(len(power))[:, None] * hop + np.arange(size)
    weight = np.zeros(int(at[-1, -1]) + 1)
    np.add.at(weight, at, np.broadcast_to(window**2, at.shape))

    def samples(spectra: np.ndarray) -> np.ndarray:
        out = np.zeros(len(weight))
        np.add.at(out, at, np.fft.irfft(spectra, size, axis=1) * window)
        return out / np.maximum(weight, 1e-8)

    turn = np.exp(2j * np.pi * np.random.default_rng(seed).random(level.shape))
    last = np.zeros_like(turn)
    for _ in range(steps):
        now = np.fft.rfft(samples(level * turn)[at] * window, axis=1)
        turn = now - 0.99 / 1.99 * last
        turn, last = turn / np.maximum(np.abs(turn), 1e-12), now
    return samples(level * turn)[size // 2 : size // 2 + (len(power) - 1) * hop]


def resampled(samples: np.ndarray, rate: int, to: int, crossings: int = 32) -> np.ndarray:
    """Samples at another rate, by a windowed sinc below the lower of the two half rates; ceil(n * to / rate) of them."""
    samples = np.asarray(samples, dtype=np.float64)
    if rate == to or not len(samples):
        return samples
    cut = min(1.0, to / rate)
    half = int(np.ceil(crossings / cut))
    padded, n = np.pad(samples, half), -(-len(samples) * to // rate)
    out = np.zeros(n)
    for start in range(0, n, 8192):
        place = np.arange(start, min(start + 8192, n)) * (rate / to)
        near = np.floor(place).astype(np.int64)[:, None] + np.arange(-half + 1, half + 1)
        off = place[:, None] - near
        weight = cut * np.sinc(cut * off) * (0.5 + 0.5 * np.cos(np.pi * np.clip(off / half, -1, 1)))
        out[start : start + 8192] = (padded[np.minimum(near + half, len(padded) - 1)] * weight).sum(axis=1)
    return out
