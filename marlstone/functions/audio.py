"""Audio: WAV decoding and frame features with numpy, one file per row.

Frames of 2,048 samples every 512, centred with zero padding."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RATE, FRAME, HOP, LONGEST, SILENCE = 22_050, 2048, 512, 300.0, 1e-6
OUT = "path string, frames int, rms array<double>, zcr array<double>, centroid array<double>, bandwidth array<double>, pitch array<double>, mfcc array<array<double>>, chroma array<array<double>>, reason_code string"


def decode_wav(data: bytes) -> np.ndarray:
    """Mono samples in [-1, 1] at ``RATE``, at most ``LONGEST`` seconds. Raises ValueError with a reason."""
    if not data:
        raise ValueError("empty_file")
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
            raw = w.readframes(min(w.getnframes(), int(LONGEST * rate)))
    except (wave.Error, EOFError) as error:
        raise ValueError("decode_failed") from error
    if width not in (1, 2, 4):
        raise ValueError("unsupported_width")
    x = np.frombuffer(raw[: len(raw) - len(raw) % (width * channels)], {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        n = max(1, round(len(x) * RATE / rate))
        x = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
    if not len(x) or np.abs(x).max() < SILENCE:
        raise ValueError("silent_audio")
    return x


def framed(x: np.ndarray, frame: int = FRAME) -> np.ndarray:
    padded = np.pad(x, frame // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::HOP]


def spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins) under a periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    return np.abs(np.fft.rfft(framed(x) * window, axis=1))


def rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((framed(x) ** 2).mean(1))


def zero_crossings(x: np.ndarray) -> np.ndarray:
    f = np.signbit(framed(x))
    return (f[:, 1:] != f[:, :-1]).sum(1) / f.shape[1]


def centroid_bandwidth(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hz = np.arange(m.shape[1]) * RATE / FRAME
    total = np.where(m.sum(1) == 0, 1.0, m.sum(1))
    centre = (m * hz).sum(1) / total
    return centre, np.sqrt((m * (hz - centre[:, None]) ** 2).sum(1) / total)


def mel_filters(n: int = 128) -> np.ndarray:
    """Triangular filters, equal steps on the mel scale (linear below 1 kHz, logarithmic above), unit area."""
    step = np.log(6.4) / 27
    mel = lambda hz: np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1) / 1000) / step)
    hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    edges = hz(np.linspace(0, mel(np.array(RATE / 2)), n + 2))
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(m: np.ndarray, n: int = 20) -> np.ndarray:
    """(n, frames): orthonormal cosine transform of the mel power in decibels, 80 dB below the peak at most."""
    power = mel_filters() @ (m**2).T
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k, size = np.arange(n)[:, None], len(db)
    basis = np.cos(np.pi * k * (np.arange(size) + 0.5) / size) * np.sqrt(2 / size)
    basis[0] /= np.sqrt(2)
    return basis @ db


def chroma(m: np.ndarray) -> np.ndarray:
    """(12, frames): spectral power by pitch class (C first), each frame scaled to a peak of 1."""
    bins = np.arange(1, m.shape[1])
    cls = np.round(12 * np.log2(bins * RATE / FRAME / 440.0) + 9).astype(int) % 12
    out = np.stack([(m[:, 1:][:, cls == c] ** 2).sum(1) for c in range(12)])
    return out / np.maximum(out.max(0), 1e-12)


def yin(x: np.ndarray, low: float = 32.7, high: float = 4186.0, threshold: float = 0.1) -> np.ndarray:
    """One fundamental per frame (de Cheveigne and Kawahara 2002): the first dip of the normalised difference
    below the threshold, else its smallest value, refined by a parabola."""
    f = framed(x)
    half = FRAME // 2
    shortest, longest = max(1, int(RATE / high)), min(int(RATE / low) + 1, half - 1)
    spectra = np.fft.rfft(f, 2 * FRAME, axis=1)
    head = np.fft.rfft(f[:, :half], 2 * FRAME, axis=1)
    product = np.fft.irfft(spectra * head.conj(), axis=1)[:, : longest + 1]
    energy = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f**2, axis=1)], axis=1)
    lags = np.arange(longest + 1)
    difference = np.maximum(energy[:, half : half + 1] + energy[:, half + lags] - energy[:, lags] - 2 * product, 0)
    running = np.cumsum(difference[:, 1:], axis=1) / np.arange(1, longest + 1)
    d = np.concatenate([np.ones((len(f), 1)), difference[:, 1:] / np.maximum(running, 1e-12)], axis=1)
    out = np.empty(len(f))
    for i, row in enumerate(d):
        own = row[shortest : longest + 1]
        dips = np.flatnonzero((own[1:-1] < own[:-2]) & (own[1:-1] <= own[2:]) & (own[1:-1] < threshold)) + 1
        at = int(dips[0] if len(dips) else own.argmin()) + shortest
        shift = 0.0
        if shortest < at < longest:
            a, b, c = row[at - 1], row[at], row[at + 1]
            shift = (a - c) / (2 * (a - 2 * b + c)) if a - 2 * b + c > 1e-12 else 0.0
        out[i] = RATE / (at + np.clip(shift, -1, 1))
    return out


def features(data: bytes) -> dict:
    x = decode_wav(data)
    m = spectrum(x)
    centre, width = centroid_bandwidth(m)
    return {"frames": len(m), "rms": rms(x), "zcr": zero_crossings(x), "centroid": centre, "bandwidth": width, "pitch": yin(x), "mfcc": list(mfcc(m)), "chroma": list(chroma(m))}


def extract(files: DataFrame) -> DataFrame:
    """Features of each file of a ``binaryFile`` scan (path, content), or the reason why there are none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append({"path": path, **features(bytes(data)), "reason_code": None})
                except ValueError as error:
                    rows.append({"path": path, "frames": 0, "reason_code": str(error)})
            columns = [x.split()[0] for x in OUT.split(", ")]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    return files.select("path", "content").mapInPandas(run, OUT)


def traditional_vector(frames: DataFrame) -> DataFrame:
    """72 values per path: means, then population stds of 20 MFCC and 12 chroma channels, then mean and std
    of centroid, bandwidth, zero crossings and loudness."""
    from pyspark.sql import functions as F

    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    guarded = lambda a: F.sqrt(F.greatest(F.lit(0.0), F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a) - mean(a) * mean(a)))
    both = lambda c: F.concat(F.transform(c, mean), F.transform(c, guarded))
    single = [F.array(mean(F.col(c)), guarded(F.col(c))) for c in ("centroid", "bandwidth", "zcr", "rms")]
    return frames.where("reason_code is null").select("path", F.concat(both("mfcc"), both("chroma"), *single).alias("vector"))
