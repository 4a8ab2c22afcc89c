"""Audio features: reading PCM, resampling, and log-mel spectra, in NumPy over Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, SAMPLES, FRAME, HOP, BANDS, LOW, HIGH, FLOOR = 48_000, 480_000, 1024, 480, 64, 50.0, 14_000.0, 1e-10
EXCERPT_S = 10


def _mel(hz: np.ndarray | float) -> np.ndarray:
    """Slaney's scale: linear to 1 kHz, logarithmic above."""
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=1)
def _bank() -> tuple[np.ndarray, np.ndarray]:
    """The window, and the triangular filters over power bins, each of unit area."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    edges = _hertz(np.linspace(_mel(LOW), _mel(HIGH), BANDS + 2))
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    rise = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return window, np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def padded(pcm: np.ndarray) -> np.ndarray:
    """Ten seconds: cut, or whole repetitions and then silence."""
    if len(pcm) >= SAMPLES:
        return pcm[:SAMPLES]
    if not len(pcm):
        return np.zeros(SAMPLES)
    times = SAMPLES // len(pcm)
    return np.concatenate([np.tile(pcm, times), np.zeros(SAMPLES - times * len(pcm))])


def log_mel(pcm: np.ndarray) -> np.ndarray:
    """Decibels of 1001 frames by 64 bands, flat."""
    window, bank = _bank()
    x = np.pad(padded(np.asarray(pcm, dtype=float)), FRAME // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return (10 * np.log10(np.maximum(power @ bank.T, FLOOR))).ravel()


def mono(pcm16: np.ndarray, channels: int, rate: int) -> np.ndarray:
    """One channel at 48 kHz of interleaved 16-bit samples: their mean, interpolated, the last sample held."""
    x = pcm16[: len(pcm16) // channels * channels].reshape(-1, channels).mean(1) / 32768
    if rate == RATE or not len(x):
        return x
    at = np.arange(int(len(x) * RATE / rate)) * rate / RATE
    return np.interp(at, np.arange(len(x)), x)


def excerpt(data: bytes) -> np.ndarray | None:
    """The middle ten seconds of a 16-bit WAV file; None if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return None
            rate, n = f.getframerate(), f.getnframes()
            f.setpos(max(0, (n - EXCERPT_S * rate) // 2))
            raw = f.readframes(min(n, EXCERPT_S * rate))
            return mono(np.frombuffer(raw, dtype="<i2"), f.getnchannels(), rate)
    except (wave.Error, EOFError, ValueError):
        return None


def resampled(rows: DataFrame, rate: int, channels: int = 1, pcm: str = "pcm", samples: str = "samples") -> DataFrame:
    """rows with samples, one channel at RATE of the interleaved 16-bit pcm (array<smallint>), in its place. Null stays null, a part of a frame at the end is left out."""
    others = [c for c in rows.columns if c != pcm]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(others)).to_pylist()
            out = [None if x is None else mono(np.asarray(x, dtype="<i2"), channels, rate) for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*others, samples])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.select(*others, pcm).mapInArrow(run, f"{kinds}`{samples}` array<double>")


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def analysed(files: DataFrame, encode: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(path, vector): an encoder's unit vector of each file's features, zeros where decoding or encoding fails. files: path, content, and columns that pass.

    Without an encoder, the mean and deviation of each band stand in, and are no learned embedding.
    """
    size = 2 * BANDS

    def plain(features: np.ndarray) -> np.ndarray:
        bands = features.reshape(-1, BANDS)
        return np.concatenate([bands.mean(0), bands.std(0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                pcm = excerpt(data) if data else None
                v = np.zeros(size) if pcm is None else np.asarray((encode or plain)(log_mel(pcm)), dtype=float)
                n = np.sqrt(v @ v)
                out.append((v / n if n > 0 and np.isfinite(n) else np.zeros(len(v))).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32())), *batch.columns[2:]], ["path", "vector", *others])

    others = [c for c in files.columns if c not in ("path", "content")]
    passed = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in others)
    return files.select("path", "content", *others).mapInArrow(run, f"path string, vector array<float>{passed}")


def encoded(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The vector column as bytes of little-endian 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch.column(batch.schema.get_field_index("__v")).to_pylist()]
            keep = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__v"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(raw, pa.binary())], [*(n for n in batch.schema.names if n != "__v"), vector])

    others = [c for c in vectors.columns if c != vector]
    fields = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in others)
    return vectors.select(*others, F.col(vector).alias("__v")).mapInArrow(run, f"{fields}`{vector}` binary")


def decoded(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Bytes as vectors, a trailing part of a float left out; null bytes are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v, dtype="<f4", count=len(v) // 4).tolist() for v in batch.column(batch.schema.get_field_index("__v")).to_pylist()]
            keep = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__v"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(values, pa.list_(pa.float32()))], [*(n for n in batch.schema.names if n != "__v"), vector])

    others = [c for c in rows.columns if c != vector]
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.where(F.col(vector).isNotNull()).select(*others, F.col(vector).alias("__v")).mapInArrow(run, f"{fields}`{vector}` array<float>")
