"""Media columns: audio features of 8-bit samples.

A payload of bytes is stored as an unsigned 8-bit mono WAV file, in a column of a written table, and read back from that
table. Features come from what was read: a polyphase filter changes the rate, overlapping windows give log-mel energies,
and a two-threshold (hysteresis) walk over frame energies finds the active spans. Spans are cut into tensors of a fixed
shape [frames, mels], the last one padded, each with its start and end in seconds. Each task stores them, in half
precision, as Arrow fixed-shape tensors in Parquet files of bounded size in the shared folder (whole or not at all),
reads each file again, and makes the features of its rows from that.

Work on one file does not look at another, so equal bytes give equal values wherever they lie. Long files are
processed in runs of frames, so memory does not grow with them beyond their bytes and energies.

Defined results: a null text counts as the empty text (one unit of padding); null ids pass through; repeated rows
repeat; other columns are left out; an empty table gives no rows; a file without an active span has no tensors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from seine.llm.common import Workspace, create, opened, table

UNIT, PAD = 576, b"\xff"
RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, FFT, MELS = 300, 120, 512, 24
#: Frames over HIGH dB above the quiet floor open a span, frames under LOW close it; spans shorter than SHORT are left out.
#: The floor is the level that a tenth of the frames stay below, but QUIET at most: steady sound is active throughout.
HIGH, LOW, SHORT, QUIET = 9.0, 5.0, 3, -45.0
#: Tensors from which on a file of them ends.
SHARD = 1 << 14
SHAPE = (32, MELS)
RUN = 1 << 13

HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; RIFF pads odd data with one byte."""
    n = len(samples)
    return HEAD.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def samples_of(data: bytes) -> tuple[int, bytes]:
    """Rate and samples, walking the chunks of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache(None)
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low pass cut into `up` phases of `taps` coefficients."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * up
    return np.ascontiguousarray(h.reshape(taps, up).T).astype(np.float32)


def resampled(x: np.ndarray, a: int, b: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output samples a..b-1; silence lies outside the input. Output m is phase (m*down) % up over inputs up to (m*down) // up."""
    h = phases(up, down)
    taps = h.shape[1]
    lo, hi = a * down // up - taps + 1, (b - 1) * down // up + 1
    span = np.zeros(hi - lo, np.float32)
    part = x[max(lo, 0) : max(min(hi, len(x)), 0)]
    span[max(lo, 0) - lo : max(lo, 0) - lo + len(part)] = (part.astype(np.float32) - 128) / 128
    out = np.empty(b - a, np.float32)
    for r in range(min(up, b - a)):
        m = np.arange(a + r, b, up)
        first, step, n = int(m[0]) * down // up - lo, down, len(m)
        phase = h[int(m[0]) * down % up]
        y = np.zeros(n, np.float32)
        for k in range(taps):
            y += phase[k] * span[first - k : first - k + step * (n - 1) + 1 : step]
        out[r::up] = y
    return out


@lru_cache(None)
def mel_bank(rate: int = RATE * UP // DOWN) -> np.ndarray:
    """Triangles that are evenly spaced on the mel scale, FFT bins by MELS."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up, down = (f[:, None] - edge[:-2]) / np.diff(edge)[:-1], (edge[2:] - f[:, None]) / np.diff(edge)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache(None)
def window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames by MELS) and the energy of each frame in dB. The last frame is padded with silence."""
    n = -(-len(x) * UP // DOWN)
    frames = 1 + max(0, -(-(n - FRAME) // HOP))
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, RUN):
        b = min(frames, a + RUN)
        y = resampled(x, a * HOP, (b - 1) * HOP + FRAME)
        rows = np.lib.stride_tricks.as_strided(y, (b - a, FRAME), (4 * HOP, 4)) * window()
        power = np.abs(np.fft.rfft(rows, FFT, axis=1)) ** 2
        mels[a:b] = np.log(power.astype(np.float32) @ mel_bank() + 1e-6)
        energy[a:b] = 10 * np.log10((rows * rows).mean(axis=1) + 1e-9)
    return mels, energy


def spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Active runs of frames: each opens at a frame over HIGH and goes on until one under LOW, both above the quiet floor."""
    floor = min(np.partition(energy, len(energy) // 10)[len(energy) // 10], QUIET)
    mark = np.where(energy >= floor + HIGH, 1, np.where(energy < floor + LOW, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    on = np.concatenate(([0], (mark[at] == 1).astype(np.int8), [0]))
    turn = np.diff(on)
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)) if b - a >= SHORT]


def tensors(mels: np.ndarray, found: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors of SHAPE and their time spans in seconds."""
    out, when = [], []
    per = HOP / (RATE * UP / DOWN)
    for a, b in found:
        for i in range(a, b, SHAPE[0]):
            j = min(b, i + SHAPE[0])
            block = np.zeros(SHAPE, np.float32)
            block[: j - i] = mels[i:j]
            out.append(block)
            when.append((i * per, (j - 1) * per + FRAME * per / HOP))
    return np.array(out, np.float32).reshape(-1, *SHAPE), when


KIND = pa.fixed_shape_tensor(pa.float16(), SHAPE)
TENSORS = pa.schema({"row": pa.int64(), "id": pa.int64(), "start_s": pa.float64(), "end_s": pa.float64(), "log_mel": KIND})


def tensor_batch(rows: list[int], keys: list[int | None], when: list[tuple[float, float]], blocks: np.ndarray) -> pa.RecordBatch:
    """A batch with a fixed-shape tensor column. row: number of the media row within its task."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(blocks.astype(np.float16).reshape(-1)), SHAPE[0] * SHAPE[1])
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.int64()), pa.array([a for a, _ in when], pa.float64()), pa.array([b for _, b in when], pa.float64()), pa.ExtensionArray.from_storage(KIND, storage)], schema=TENSORS)


def stored_tensors(uri: str) -> Iterator[tuple[list[int], list[tuple[float, float]], np.ndarray]]:
    """Rows, time spans and tensors of a file, in runs."""
    with opened(uri) as f:
        for batch in pq.ParquetFile(f).iter_batches(1024):
            tensors_ = batch.column(4).to_numpy_ndarray() if batch.num_rows else np.empty((0, *SHAPE), np.float16)
            yield batch.column(0).to_pylist(), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())), tensors_


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, sizes, files = batch.column(0).slice(at, 500), [], []
                for t in batch.column(1).slice(at, 500):
                    raw = (t.as_py() or "").encode()
                    sizes.append(len(raw))
                    files.append(wav(raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors long, tensor_file string"


def audio_features(media: DataFrame, to: str) -> DataFrame:
    """Per row of `media`: sizes and digests of the payload and of the stored file, a summary of the features, how many
    tensors it has and the file below `to` that holds them. Lazy: what reads the rows writes the files."""

    def run(batches):
        part, names, k, row = TaskContext.get().partitionId(), [x.split()[0] for x in SCHEMA.split(", ")], 0, 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def features() -> Iterator[tuple[int, int | None, list, str, list, np.ndarray]]:
            for batch in batches:
                for key, size, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    stored = stored.as_py()
                    rate, back = samples_of(stored)
                    mels, energy = log_mel(np.frombuffer(back, np.uint8))
                    found = spans(energy)
                    block, when = tensors(mels, found)
                    text = f"rate={rate};frames={len(energy)};spans={len(found)};active={sum(b - a for a, b in found)};db={energy.mean(dtype=np.float64):.2f};mel={mels.mean(dtype=np.float64):.2f}"
                    yield key, [size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest()], text, when, block

        todo = features()
        item = next(todo, None)
        while item is not None:
            uri, held, n = f"{to}/tensors-{part:06d}-{k:06d}.parquet", [], 0
            with create(uri) as out, pq.ParquetWriter(out, TENSORS, compression="zstd") as writer:
                while item is not None and n < SHARD:
                    rows, keys, when, blocks = [], [], [], [np.empty((0, *SHAPE), np.float32)]
                    while item is not None and len(rows) < 1024:
                        key, sizes, text, spans_, block = item
                        rows += [row] * len(block)
                        keys += [key] * len(block)
                        when += spans_
                        blocks.append(block)
                        held.append((row, key, sizes, text))
                        row += 1
                        item = next(todo, None)
                    writer.write_batch(tensor_batch(rows, keys, when, np.concatenate(blocks)))
                    n += len(rows)
            # from here on only what the file holds
            prints, counts = {r: hashlib.sha256() for r, *_ in held}, dict.fromkeys((r for r, *_ in held), 0)
            for rows, when, blocks in stored_tensors(uri):
                for r, (start, end), block in zip(rows, when, blocks):
                    prints[r].update(struct.pack("<dd", start, end) + block.astype("<f2").tobytes())
                    counts[r] += 1
            for at in range(0, len(held), 1000):
                cols = zip(*((key, *sizes, f"{text};tensors={counts[r]};print={prints[r].hexdigest()[:16]}", counts[r], uri) for r, key, sizes, text in held[at : at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names)
            k += 1

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op9")
    media = work.write(stored_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return audio_features(media, work.path("tensors")).drop("tensor_file")


QUERIES = {"op9_audio": op9_audio}
SQL: dict[str, str] = {}
