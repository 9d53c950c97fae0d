"""Media columns: audio features as fixed-shape tensors with time spans.

A media column holds clips as bytes: unsigned 8-bit PCM, one channel, at ``rate`` samples a second, 44,100 unless told otherwise.
Clips are resampled to 16 kHz with a polyphase filter: the phases of a windowed-sinc low-pass (160 from 44.1 kHz) are the columns of one
banded matrix, so a block of samples in (441) gives one of samples out (160) by one product. Frames of 25 ms, every 10 ms, give log-mel energies. Segments of activity are found by
hysteresis: they begin where a frame's energy rises over ``HIGH_DB`` above the clip's noise floor and end where it falls
under ``LOW_DB`` above it; the floor is the clip's 10th percentile.

A row is a window of ``FRAMES`` frames: (doc_id, window, start_ms, end_ms, frames, features, segments), features an array of
FRAMES x MELS floats, zero after the last frame. Spark has no fixed-shape type: the column's metadata names Arrow's, ``tensors`` gives
a table's data in it, and ``write_tensors`` stores windows as Parquet files with it, written by the tasks.

The test tables have no audio, so the query reads the UTF-8 bytes of each document's text as its clip.

Defined results: null and empty media, and empty tables, give no rows; media shorter than a frame give one frame, padded with silence;
long media give as many windows as they last; media of constant level have no segments, and a level exactly at a limit begins or goes on
with a segment; repeated rows give equal rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE_IN, RATE_OUT, UP, DOWN = 44_100, 16_000, 160, 441
WINDOW, HOP, FFT, MELS, FRAMES = 400, 160, 512, 64, 16
HALF = 24  # input samples on either side that an output sample depends on
HIGH_DB, LOW_DB = 9.0, 4.0
SHAPE = [FRAMES, MELS]


def ratio(rate: int = RATE_IN) -> tuple[int, int, int]:
    """Samples out and in of a block, and input samples on either side that an output sample depends on."""
    if rate <= 0:
        raise ValueError(f"a rate of {rate}")
    n = gcd(RATE_OUT, rate)
    return RATE_OUT // n, rate // n, ceil(HALF * max(1.0, rate / RATE_IN))


@lru_cache(maxsize=8)
def polyphase(rate: int = RATE_IN) -> np.ndarray:
    """[samples in + 2 * half, samples out]: output m of a block is the windowed sinc centred at its input time."""
    up, down, half = ratio(rate)
    t = np.arange(down + 2 * half)[:, None] - half - np.arange(up)[None, :] * (down / up)
    cut = min(1.0, RATE_OUT / rate) * 0.95
    taps = np.where(np.abs(t) < half, np.sinc(cut * t) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1))), 0)
    return (taps / taps.sum(0)).astype(np.float32)


@lru_cache(maxsize=1)
def mel_filters() -> np.ndarray:
    """[FFT / 2 + 1, MELS] triangular filters, evenly spaced on the mel scale up to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * RATE_OUT / FFT
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def frame_counts(samples_in: np.ndarray, rate: int = RATE_IN) -> np.ndarray:
    up, down, _ = ratio(rate)
    out = -(-samples_in * up // down)
    return np.where(samples_in > 0, 1 + np.maximum(0, out - WINDOW) // HOP, 0)


def resample(clips: list[bytes], rate: int = RATE_IN) -> tuple[np.ndarray, np.ndarray]:
    """Resampled clips end to end, each from a whole block with silence for a window after it, and where each starts."""
    up, down, half = ratio(rate)
    sizes = np.array([len(c) for c in clips], np.int64)
    blocks = -(-sizes // down) + -(-WINDOW // up)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    x = np.zeros(int(starts[-1]) * down + 2 * half, np.float32)
    for k, c in enumerate(clips):
        at = half + int(starts[k]) * down
        x[at : at + len(c)] = np.frombuffer(c, np.uint8)
        x[at : at + len(c)] -= 128
    x /= 128
    frames = np.lib.stride_tricks.sliding_window_view(x, down + 2 * half)[::down]
    return (frames @ polyphase(rate)).reshape(-1), starts[:-1] * up


def log_mel(clips: list[bytes], rate: int = RATE_IN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-mel energies [frames, MELS], energy in dB by frame, number of frames of each clip)."""
    y, starts = resample(clips, rate)
    n = frame_counts(np.array([len(c) for c in clips], np.int64), rate)
    first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * HOP
    hann = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)
    mels, power = np.empty((len(first), MELS), np.float32), np.empty(len(first), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(y, WINDOW) if len(y) >= WINDOW else np.zeros((0, WINDOW), np.float32)
    for a in range(0, len(first), 2048):
        w = windows[first[a : a + 2048]]
        power[a : a + 2048] = (w * w).mean(1)
        spectrum = np.fft.rfft(w * hann, FFT, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a : a + 2048] = np.log10(np.maximum(energy @ mel_filters(), 1e-10))
    return mels, 10 * np.log10(np.maximum(power, 1e-10)), n


def activity(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """[begin, end) frames of the segments of one clip."""
    if not len(db):
        return []
    floor = np.quantile(db, 0.1, method="lower")
    state = np.where(db >= floor + high, 1, np.where(db < floor + low, 0, -1))
    known = np.flatnonzero(state >= 0)
    last = np.searchsorted(known, np.arange(len(db)), "right") - 1
    on = np.where(last >= 0, state[known[np.maximum(last, 0)]] if len(known) else 0, 0) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


SCHEMA = "doc_id long, window long, start_ms long, end_ms long, frames int, features array<float>, segments array<struct<start_ms: long, end_ms: long>>"
_SEGMENT = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])


def _windows(ids: pa.Array, clips: list[bytes], rate: int = RATE_IN) -> pa.RecordBatch:
    mels, db, n = log_mel(clips, rate)
    rows = -(-n // FRAMES)
    clip = np.repeat(np.arange(len(clips)), rows)
    window = np.arange(len(clip)) - np.repeat(np.cumsum(rows) - rows, rows)
    frames = np.minimum(FRAMES, n[clip] - window * FRAMES)
    data = np.zeros((len(clip) * FRAMES, MELS), np.float32)
    at = np.repeat(np.arange(len(clip)) * FRAMES, frames) + (np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames))
    data[at] = mels
    begins = np.concatenate([[0], np.cumsum(n)])
    parts: list[list[dict]] = []
    for k in range(len(clips)):
        found = activity(db[begins[k] : begins[k + 1]])
        for w in range(rows[k]):
            a, b = w * FRAMES, (w + 1) * FRAMES
            parts.append([{"start_ms": max(s, a) * 10, "end_ms": min(e, b) * 10} for s, e in found if s < b and e > a])
    features = pa.ListArray.from_arrays(np.arange(len(clip) + 1, dtype=np.int32) * (FRAMES * MELS), data.reshape(-1))
    start = window * FRAMES * 10
    return pa.RecordBatch.from_arrays([ids.take(pa.array(clip)), pa.array(window), pa.array(start), pa.array(start + (frames - 1) * 10 + 25), pa.array(frames.astype(np.int32)), features, pa.array(parts, pa.list_(_SEGMENT))], names=["doc_id", "window", "start_ms", "end_ms", "frames", "features", "segments"])


def features(media: DataFrame, clip: Column, id_col: str = "doc_id", batch_bytes: int = 1_000_000, rate: int = RATE_IN) -> DataFrame:
    """The windows of every clip of the binary column ``clip``."""
    ratio(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for k, c in enumerate(batch.column(1)):
                data = c.as_py() or b""
                held.append(data)
                size += len(data)
                if size >= batch_bytes or k == batch.num_rows - 1:
                    yield _windows(batch.column(0).slice(begin, len(held)), held, rate)
                    held, size, begin = [], 0, k + 1

    tensor = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": SHAPE})}
    out = media.select(F.col(id_col).cast("long").alias("doc_id"), clip.cast("binary").alias("clip")).where("length(clip) > 0").mapInArrow(run, SCHEMA)
    return out.withMetadata("features", tensor)


def tensors(table: pa.Table) -> pa.Table:
    """``table`` (from ``features``) with the features as Arrow fixed-shape tensors."""
    column = table["features"].combine_chunks()
    values = column.flatten()
    fixed = pa.FixedSizeListArray.from_arrays(values, FRAMES * MELS)
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    return table.set_column(table.schema.get_field_index("features"), "features", pa.ExtensionArray.from_storage(kind, fixed.cast(kind.storage_type)))


def write_tensors(found: DataFrame, path: str) -> DataFrame:
    """(file, windows): windows (from ``features``) as Parquet files whose features are Arrow fixed-shape tensors.

    ``path`` is a URI of a folder that all executors reach. A task writes under a name of its attempt and renames its file when it is
    whole, so that one that runs again replaces what it wrote before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():05d}.parquet"
        writer, rows = None, 0
        for batch in batches:
            table = tensors(pa.Table.from_batches([batch]))
            writer = writer or pyarrow.parquet.ParquetWriter(f"{name}.{task.taskAttemptId()}", table.schema, filesystem=fs)
            writer.write_table(table)
            rows += len(table)
        if writer:
            writer.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["file", "windows"])

    return found.mapInArrow(run, "file string, windows long")
