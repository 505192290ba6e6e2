"""Sound: WAV headers and samples, mixdown, resampling, spectral measures. Spark deals out the files or arrays; each batch goes through numpy."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructType

RATE, FRAME, HOP, ROLL = 16000, 2048, 512, 0.85
INFO = StructType().add("duration", DoubleType()).add("sample_rate", IntegerType()).add("channels", IntegerType())
SPECTRAL = StructType().add("spectral_centroid", DoubleType()).add("spectral_rolloff", DoubleType()).add("zero_crossing_rate", DoubleType())
#: Zero crossings of the resampling kernel on either side, and the share of the lower Nyquist frequency it keeps.
LOBES, KEPT = 6, 0.99


def header(data: bytes | None) -> dict | None:
    """sample_rate, channels, bits, floating, start and size of the samples of a WAV file; None where it is not one, or holds no samples' chunk."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, out = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE and size >= 26 and at + 34 <= len(data):  # the kind proper stands in the extension
                kind = struct.unpack_from("<H", data, at + 32)[0]
            if kind not in (1, 3) or not channels or not rate or bits not in ((32, 64) if kind == 3 else (8, 16, 24, 32)):
                return None
            out = {"sample_rate": rate, "channels": channels, "bits": bits, "floating": kind == 3}
        elif name == b"data" and out:
            return out | {"start": at + 8, "size": min(size, len(data) - at - 8)}
        at += 8 + size + size % 2
    return None


def decoded(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples from -1 to 1, channels averaged, and the rate."""
    h = header(data)
    if h is None:
        return None
    width = h["bits"] // 8
    frames = h["size"] // (width * h["channels"])
    raw = np.frombuffer(data, np.uint8, frames * width * h["channels"], h["start"])
    if h["floating"]:
        x = raw.view(f"<f{width}").astype(np.float64)
    elif width == 1:
        x = (raw.astype(np.float64) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = raw.reshape(-1, 3)
        x = wide.view("<i4").ravel() / float(1 << 31)
    else:
        x = raw.view(f"<i{width}") / float(1 << (h["bits"] - 1))
    return x.reshape(frames, h["channels"]).mean(axis=1), h["sample_rate"]


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at another rate: each new sample is a windowed-sinc mean of the old ones around it, band-limited to the lower rate."""
    if rate == target or not len(x):
        return x
    n = -(-len(x) * target // rate)
    band = min(rate, target) * KEPT / rate  # of the old rate
    reach = int(np.ceil(LOBES / band))
    padded, out = np.pad(x, reach + 1), np.empty(n)
    taps = np.arange(-reach, reach + 1)
    for lo in range(0, n, 1 << 16):
        at = np.arange(lo, min(n, lo + (1 << 16)))
        whole, part = at * rate // target, (at * rate % target) / target
        t = np.clip((taps - part[:, None]) * band, -LOBES, LOBES)
        weight = np.sinc(t) * np.cos(t * np.pi / LOBES / 2) ** 2 * band
        out[at] = (padded[whole[:, None] + taps + reach + 1] * weight).sum(axis=1)
    return out


def encoded(x: np.ndarray, rate: int, channels: int, bits: int = 16, floating: bool = False) -> bytes:
    """A WAV file of samples (interleaved): whole numbers of 8 (unsigned), 16, 24 or 32 bits, those beyond -1 to 1 clipped, or floats of 32 or 64."""
    if floating:
        body = x.astype(f"<f{bits // 8}").tobytes()
    else:
        whole = np.clip(np.floor(x * 2.0 ** (bits - 1) + 0.5), -(2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1).astype(np.int64)
        body = (whole + 128).astype(np.uint8).tobytes() if bits == 8 else whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    head = struct.pack("<HHIIHH", 3 if floating else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body + pad


def _frames(x: np.ndarray) -> Iterator[np.ndarray]:
    """Frames of an array that is padded already, some thousand at a time."""
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for lo in range(0, len(views), 1024):
        yield views[lo : lo + 1024]


def spectrum_of(x: np.ndarray, rate: int) -> tuple[float, float, float]:
    """Means over frames of the spectral centroid, of the frequency below which ROLL of the magnitude lies, and of the share of sign changes."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    freq = np.arange(FRAME // 2 + 1) * rate / FRAME
    centroid, roll, cross, n = 0.0, 0.0, 0.0, 0
    for part in _frames(np.pad(x, FRAME // 2)):
        size = np.abs(np.fft.rfft(part * window, axis=1))
        total = size.sum(axis=1)
        centroid += ((size * freq).sum(axis=1) / np.where(total > np.finfo(np.float32).tiny, total, 1.0)).sum()
        roll += freq[(np.cumsum(size, axis=1) >= ROLL * total[:, None]).argmax(axis=1)].sum()
        n += len(part)
    for part in _frames(np.pad(x, FRAME // 2, mode="edge")):
        below = np.where(np.abs(part) <= 1e-10, 0.0, part) < 0
        cross += (below[:, 1:] != below[:, :-1]).sum() / FRAME
    return centroid / n, roll / n, cross / n


@F.pandas_udf(INFO)
def audio_info(content: pd.Series) -> pd.DataFrame:
    """Facts of a WAV file's header; nulls where it cannot be read."""
    found = [header(x) for x in content]
    return pd.DataFrame([(h["size"] // (h["bits"] // 8 * h["channels"]) / h["sample_rate"], h["sample_rate"], h["channels"]) if h else (None, None, None) for h in found], columns=["duration", "sample_rate", "channels"]).astype({"sample_rate": "Int32", "channels": "Int32"})


@F.pandas_udf(ArrayType(FloatType()))
def waveform(content: pd.Series) -> pd.Series:
    """Samples of a WAV file, channels averaged, at RATE; null where it cannot be read."""
    found = [decoded(x) for x in content]
    return pd.Series([None if f is None else resampled(*f, RATE).astype(np.float32) for f in found], dtype=object)


@F.pandas_udf(BinaryType())
def wav_file(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else encoded(np.asarray(x, np.float64), int(r), int(c)) for x, r, c in zip(samples, rate, channels, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def wav_file_of(samples: pd.Series, rate: pd.Series, bits: pd.Series, floating: pd.Series) -> pd.Series:
    """WAV files of one channel in any of the formats."""
    return pd.Series([None if x is None else encoded(np.asarray(x, np.float64), int(r), 1, int(b), bool(f)) for x, r, b, f in zip(samples, rate, bits, floating, strict=True)], dtype=object)


@F.pandas_udf(SPECTRAL)
def spectral(wave: pd.Series) -> pd.DataFrame:
    """Spectral measures of samples at RATE; nulls where there are none."""
    found = [(None,) * 3 if x is None or not len(x) else spectrum_of(np.asarray(x, np.float64), RATE) for x in wave]
    return pd.DataFrame(found, columns=["spectral_centroid", "spectral_rolloff", "zero_crossing_rate"], dtype="float64")
