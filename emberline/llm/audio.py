"""Media columns: audio stored losslessly, and its features as tensors with time spans.

A payload of bytes is stored as 8-bit mono PCM in a WAV container. Features come
from the stored bytes: polyphase resampling, overlapped log-mel filterbanks cut
into patches of one fixed shape, and speech-like segments found from the frames'
energy with two thresholds (hysteresis).
"""

from __future__ import annotations

import functools
import io
import struct
import wave

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from . import vectext
from .common import F, quoted, whole_text

UNIT = 576
RATE, UP, DOWN = 16_000, 3, 4  # resampled to 12 kHz
TAPS = 16  # of each polyphase branch
FRAME, HOP, FFT, MELS = 300, 120, 512, 40  # 25 ms, 10 ms
PATCH = 48  # frames of a tensor
STRETCH = 1 << 19  # samples at a time, so that memory does not grow with an audio's length


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; each payload byte is a sample."""
    pad = len(payload) & 1
    head = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI", b"RIFF", len(head) + len(payload) + pad) + head + payload + b"\0" * pad


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the sample rate of a stored audio."""
    with wave.open(io.BytesIO(stored)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("only 8-bit mono audio is stored here")
        return f.readframes(f.getnframes()), f.getframerate()


@functools.cache
def branches(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase branches of a windowed-sinc low-pass filter: up x taps."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 0.92 / max(up, down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 8.0)
    return (up * h / h.sum()).reshape(taps, up).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """ceil(len(x) * up / down) samples; output m is a dot product with branch m * down % up alone."""
    h = branches(up, down)
    taps = h.shape[1]
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    windows = sliding_window_view(padded, taps)
    out = np.empty(-(-len(x) * up // down), np.float32)
    for first in range(up):
        m = np.arange(first, len(out), up)
        if len(m):
            at = first * down // up
            out[first::up] = windows[at :: down][: len(m)] @ h[first * down % up]
    return out


@functools.cache
def mel_filters(rate: int = RATE * UP // DOWN) -> np.ndarray:
    """Triangular filters, bins x mels."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(40), to_mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[None, 1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x mels) and the frames' levels in dB."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), x.dtype)])
    frames = sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    mel, level = [], []
    for k in range(0, len(frames), 2048):
        part = frames[k : k + 2048]
        part = part - part.mean(axis=1, keepdims=True)
        level.append(10 * np.log10((part * part).mean(axis=1) + 1e-9))
        spectrum = np.fft.rfft(part * window, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel.append(np.log10(power @ mel_filters() + np.float32(1e-6)))
    return np.concatenate(mel), np.concatenate(level)


def segments(level: np.ndarray, rise: float = 1.5, fall: float = 0.5) -> list[tuple[int, int]]:
    """Frame ranges that begin where the level goes `rise` dB above the median and last until it is under `fall` dB above it."""
    base = float(np.median(level))
    on = level > base + fall
    high = level > base + rise
    starts, ends = vectext.runs(on, np.array([0]))
    total = np.concatenate([[0], np.cumsum(high)])
    # a run counts from its first high frame
    found = []
    for a, b in zip(starts, ends, strict=True):
        if total[b] > total[a]:
            found.append((int(a + np.argmax(high[a:b])), int(b)))
    return found


def features(stored: bytes) -> dict:
    """Patches (each PATCH x MELS, the last padded with zeros, with its time span), segments and counts of a stored audio."""
    raw, rate = from_wav(stored)
    samples = np.frombuffer(raw, np.uint8)
    parts = [np.zeros(0, np.float32)]
    for k in range(0, len(samples), STRETCH):
        lead = min(k, DOWN * TAPS)  # a stretch is resampled with its surroundings, and so like the whole
        part = resample((samples[k - lead : k + STRETCH + DOWN * TAPS].astype(np.float32) - 128) / 128)
        parts.append(part[lead * UP // DOWN :][: -(-min(STRETCH, len(samples) - k) * UP // DOWN)])
    sound = np.concatenate(parts)
    mel, level = log_mel(sound)
    n = len(mel)
    padded = np.zeros((-(-n // PATCH) * PATCH, MELS), np.float32)
    padded[:n] = mel
    ms = 1000 * HOP * DOWN // (rate * UP)
    tail = 1000 * (FRAME - HOP) * DOWN // (rate * UP)
    patches = [{"start_ms": k * ms, "end_ms": min(k + PATCH, n) * ms + tail, "log_mel": padded[k : k + PATCH].ravel()} for k in range(0, n, PATCH)]
    found = [{"start_ms": a * ms, "end_ms": b * ms + tail} for a, b in segments(level)]
    return {"frames": n, "patches": patches, "segments": found, "mean": np.round(mel.mean(axis=0, dtype=np.float64), 2) + 0.0}


SCHEMA = "media binary, n_bytes long, frames long, patches array<struct<start_ms:long,end_ms:long,log_mel:array<float>>>, segments array<struct<start_ms:long,end_ms:long>>, mean_log_mel array<double>"


def audio(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: int = UNIT) -> DataFrame:
    """One row per document: the id column, media (a WAV file's bytes), n_bytes, frames, patches, segments and mean_log_mel.

    The payload is the text in UTF-8 with bytes 255 up to a positive multiple of
    `unit`. Null text is the empty text; a null id stays null; equal texts give
    equal values; an empty table gives no rows. to_tensors() turns the patches
    into Arrow's fixed-shape tensors.
    """
    frame = documents.select(F.col(quoted(id_column)).alias("doc"), whole_text(text_column).alias("text"))
    span = [("start_ms", pa.int64()), ("end_ms", pa.int64())]
    patch = pa.list_(pa.struct([*span, ("log_mel", pa.list_(pa.float32()))]))

    def run(frames):
        for batch in vectext.batches(frames, 1_000_000):
            data, offsets = vectext.flat(batch.column(1))
            raw = data.tobytes()
            media, made, sizes = [], [], np.diff(offsets)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b]
                media.append(to_wav(text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))))
                made.append(features(media[-1]))
            flat = [p for m in made for p in m["patches"]]
            lists = pa.ListArray.from_arrays(np.arange(0, (len(flat) + 1) * PATCH * MELS, PATCH * MELS, dtype=np.int32), pa.array(np.concatenate([p["log_mel"] for p in flat])))
            structs = pa.StructArray.from_arrays([pa.array([p["start_ms"] for p in flat], pa.int64()), pa.array([p["end_ms"] for p in flat], pa.int64()), lists], ["start_ms", "end_ms", "log_mel"])
            patches = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(m["patches"]) for m in made])]).astype(np.int32), structs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(media, pa.binary()), pa.array(sizes), pa.array([m["frames"] for m in made], pa.int64()), patches.cast(patch), pa.array([m["segments"] for m in made], pa.list_(pa.struct(span))), pa.array([m["mean"].tolist() for m in made], pa.list_(pa.float64()))],
                names=["doc", "media", "n_bytes", "frames", "patches", "segments", "mean_log_mel"],
            )

    return frame.mapInArrow(run, f"doc {frame.schema['doc'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("doc", id_column)


def to_tensors(patches: pa.Array | pa.ChunkedArray) -> pa.Table:
    """The patches of a column as a table (row, start_ms, end_ms, log_mel) whose last column has Arrow's fixed-shape tensor type."""
    if isinstance(patches, pa.ChunkedArray):
        patches = patches.combine_chunks()
    flat = patches.flatten()
    values = flat.field("log_mel").flatten()
    storage = pa.FixedSizeListArray.from_arrays(values, PATCH * MELS)
    tensors = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel")), storage)
    return pa.table({"row": patches.value_parent_indices(), "start_ms": flat.field("start_ms"), "end_ms": flat.field("end_ms"), "log_mel": tensors})


def readings(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, payload) read back from the stored audio."""
    frame = media.select(F.col(quoted(id_column)).alias("doc"), "media")

    def run(frames):
        for batch in frames:
            raw = [from_wav(m)[0] for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc", "payload"])

    return frame.mapInArrow(run, f"doc {frame.schema['doc'].dataType.simpleString()}, payload binary").withColumnRenamed("doc", id_column)


def digests(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What a catalogue keeps of each row of audio(): sizes and digests of the stored form and of the samples read back from it, and the features as one string."""
    frame = media.select(F.col(quoted(id_column)).alias("doc"), "n_bytes", "media", "frames", "segments", "mean_log_mel")
    kind = frame.schema["doc"].dataType.simpleString()

    def run(frames):
        for batch in frames:
            raw = [from_wav(m)[0] for m in batch.column("media").to_pylist()]
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "n_bytes"]
            yield pa.RecordBatch.from_arrays([kept[0], batch.column("n_bytes"), pa.array(raw, pa.binary()), *kept[1:]], names=["doc", "n_bytes", "payload", "media", "frames", "segments", "mean_log_mel"])

    read = frame.mapInArrow(run, f"doc {kind}, n_bytes long, payload binary, media binary, frames long, segments array<struct<start_ms:long,end_ms:long>>, mean_log_mel array<double>")
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s.start_ms.cast("string"), s.end_ms.cast("string"))), ",")
    feature = F.concat_ws("|", F.col("frames").cast("string"), F.array_join(F.transform("mean_log_mel", lambda x: F.format_string("%.2f", x)), ","), spans)
    return read.select(
        F.col("doc").alias(id_column), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
