"""Signal operators on arrays, in Arrow batches: mel bands, masks, warps, perturbations. Nothing is drawn at random but
by a stated seed, so that a row gives the same result wherever it is computed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR, MATRIX = "array<double>", "array<array<double>>"


def _each(f: Callable[..., np.ndarray], kind: str, *columns: Column) -> Column:
    """f of each row's arrays; null if one of them is."""

    def run(*xs: pd.Series) -> pd.Series:
        out = []
        for row in zip(*xs):
            made = None if any(x is None for x in row) else f(*(np.array([np.asarray(r, float) for r in x]) if len(x) and np.ndim(x[0]) else np.asarray(x, float) for x in row))
            out.append(None if made is None else made.tolist())
        return pd.Series(out, dtype=object)

    # As many parameters as columns: the engine looks at the signature.
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    typed = {1: one, 2: two}[len(columns)]
    typed.__annotations__ = {**{k: pd.Series for k in ("a", "b")[: len(columns)]}, "return": pd.Series}
    return F.pandas_udf(typed, kind)(*columns)


def mel_bands(bins: int, bands: int, rate: float = 16000.0) -> np.ndarray:
    """bins x bands: triangles that are evenly apart in mel (2595 log10(1 + f / 700)), each of area 1 in Hz."""
    hz = np.linspace(0, rate / 2, bins)
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (hz[:, None] - low) / (mid - low), (high - hz[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)) * 2 / (high - low)


def log_mel(spectrogram: Column, bands: int = 80, rate: float = 16000.0, floor: float = 1e-10) -> Column:
    """Natural logarithms of the mel bands' power, frame by frame."""

    def run(s: np.ndarray) -> np.ndarray:
        return np.log(np.maximum((s**2) @ mel_bands(s.shape[1], bands, rate), floor)) if s.size else s

    return _each(run, MATRIX, spectrogram)


def masked(matrix: Column, first: int, width: int, axis: int = 0, value: float = 0.0) -> Column:
    """A span of frames (axis 0) or bands (axis 1) set to a value."""

    def run(m: np.ndarray) -> np.ndarray:
        m = m.copy()
        m[(slice(first, first + width), slice(None)) if axis == 0 else (slice(None), slice(first, first + width))] = value
        return m

    return _each(run, MATRIX, matrix)


def time_warped(matrix: Column, centre: int, to: int) -> Column:
    """Frames before `centre` stretched to `to` frames and the rest to what is left, with values between neighbours;
    as they are if either side would be empty."""

    def stretched(m: np.ndarray, n: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * len(m) / n - 0.5, 0, len(m) - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, len(m) - 1)
        return m[low] + (at - low)[:, None] * (m[high] - m[low])

    def run(m: np.ndarray) -> np.ndarray:
        if not 0 < centre < len(m) or not 0 < to < len(m):
            return m
        return np.concatenate((stretched(m[:centre], to), stretched(m[centre:], len(m) - to)))

    return _each(run, MATRIX, matrix)


def speed(samples: Column, factor: float) -> Column:
    """Played so many times as fast, by values between neighbours; the length is divided by the factor, rounded."""

    def run(x: np.ndarray) -> np.ndarray:
        n = int(np.rint(len(x) / factor))
        return np.interp(np.arange(n) * factor, np.arange(len(x)), x) if len(x) else x

    return _each(run, VECTOR, samples)


def volume(samples: Column, factor: float) -> Column:
    return F.transform(samples.cast(VECTOR), lambda x: x * factor)


def band_pass(samples: Column, low: float, high: float) -> Column:
    """Frequencies between two shares of the sampling rate alone (0 to 0.5), by the Fourier transform."""

    def run(x: np.ndarray) -> np.ndarray:
        spectrum = np.fft.rfft(x)
        share = np.arange(len(spectrum)) / max(1, len(x))
        spectrum[(share < low) | (share > high)] = 0
        return np.fft.irfft(spectrum, len(x)) if len(x) else x

    return _each(run, VECTOR, samples)


def noisy(samples: Column, noise: Column, ratio_db: float) -> Column:
    """With the noise, repeated or cut to the length, added at a ratio of powers in decibels; a silent side adds
    nothing."""

    def run(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.resize(n, len(x)) if len(n) else np.zeros(len(x))
        power, other = (float(np.mean(v**2)) if len(v) else 0.0 for v in (x, n))
        return x + n * np.sqrt(power / other / 10 ** (ratio_db / 10)) if power and other else x

    return _each(run, VECTOR, samples, noise)


def reverberated(samples: Column, response: Column) -> Column:
    """Convolved with a room's response, cut to the length, at the power that it had."""

    def run(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        y = np.convolve(x, r)[: len(x)] if len(x) and len(r) else x
        power, other = float(np.mean(x**2)) if len(x) else 0.0, float(np.mean(y**2)) if len(y) else 0.0
        return y * np.sqrt(power / other) if other else y

    return _each(run, VECTOR, samples, response)


def channel(samples: Column, number: int, channels: int) -> Column:
    """One channel of samples in turn."""
    return F.filter(samples, lambda x, i: i % channels == number)


def chained(column: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """A column after several operators, one after another."""
    for step in steps:
        column = step(column)
    return column
