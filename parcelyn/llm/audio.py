"""Audio features of media columns: polyphase resampling, log-mel filterbanks and hysteresis segmentation.

A clip is a WAV file (8-bit unsigned PCM, mono) in a binary column. It is resampled by UP / DOWN with a windowed-sinc
filter in polyphase form, cut into overlapping Hann frames, and brought to log-mel energies. Segments are stretches of
frames that begin at a high energy and last until a low one. Frames are stored in blocks of a fixed shape, as an Arrow
IPC stream with a fixed-shape tensor column (half floats) and the time span of each block. Clips are stored and read
back before features are made of them, and so are the tensors and spans before their checksums are taken.

Defined results: null text is empty, so its clip is 64 zero bytes; equal texts have equal clips and features; a null
doc_id and repeated rows are kept as rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

RATE = 16_000
#: Resampling to 12 kHz in three phases, and the filter's taps for each phase.
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, BANDS = 256, 128, 24
#: Frames of one tensor block, and of one piece of work: long clips go through memory in such pieces.
BLOCK, PIECE = 16, 4096
#: Energy in dB above which a segment begins, and below which it ends.
HIGH, LOW = -12.0, -18.0
ALIGN = 64


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up with zeros to a positive multiple of ALIGN, and their number without those."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ALIGN if raw else ALIGN), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file; the samples' number is even, so that no padding byte is needed."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(clip: bytes) -> tuple[bytes, int]:
    """The samples and rate of an 8-bit mono WAV file."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(clip):
        name, size = struct.unpack_from("<4sI", clip, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", clip, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return clip[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """up x taps: the windowed-sinc low-pass at the lower of both rates, by phase."""
    n = np.arange(up * taps)
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * (n - (len(n) - 1) / 2)) * np.hamming(len(n)) * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1])


def resampled_length(n: int, up: int = UP, down: int = DOWN) -> int:
    return -(-n * up // down)


def resample(samples: np.ndarray, first: int, last: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Outputs [first, last) of 8-bit samples, as floats in [-1, 1). Silence is taken before and after the clip.

    Polyphase: output k uses phase k * down mod up on the `taps` inputs that end at k * down div up.
    """
    h, out = phases(up, down, taps), np.zeros(last - first)
    for r in range(min(up, last - first)):
        k, n = first + r, -(-(last - first - r) // up)
        start = k * down // up - (taps - 1)
        stop = start + taps + (n - 1) * down
        own = samples[max(start, 0) : max(stop, 0)].astype(np.float64)
        own = (own - 128) / 128
        own = np.concatenate([np.zeros(max(0, min(-start, stop - start))), own])
        own = np.concatenate([own, np.zeros(stop - start - len(own))])
        for t, weight in enumerate(h[k * down % up]):
            out[r::up] += weight * own[t : t + (n - 1) * down + 1 : down]
    return out


def mel_filters(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """bands x (frame / 2 + 1): triangles, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


_WINDOW = np.hanning(FRAME)
_FILTERS: dict[float, np.ndarray] = {}


def log_mel(samples: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """frames x BANDS log energies, and each frame's energy in dB, PIECE frames at a time."""
    n = max(1, -(-(resampled_length(len(samples)) - FRAME) // HOP) + 1)
    filters = _FILTERS.setdefault(rate, mel_filters(rate).T.copy())
    mel, level = np.empty((n, BANDS), np.float32), np.empty(n)
    for at in range(0, n, PIECE):
        end = min(n, at + PIECE)
        x = resample(samples, at * HOP, (end - 1) * HOP + FRAME)
        part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)) ** 2
        mel[at:end] = np.log(power @ filters + 1e-6)
        level[at:end] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    return mel, level


def segments(level: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Stretches [first, last) of frames: begun at `high` or above, ended below `low`."""
    state = np.where(level >= high, 1, np.where(level < low, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def as_tensors(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow IPC stream: blocks of BLOCK x BANDS (the last filled with its floor) with start and end in seconds."""
    import pyarrow as pa

    n = -(-len(mel) // BLOCK)
    full = np.full((n * BLOCK, BANDS), np.float16(np.log(1e-6)))
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), [BLOCK, BANDS])
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), BLOCK * BANDS)
    start = np.arange(n) * BLOCK * HOP / rate
    end = ((np.minimum(np.arange(1, n + 1) * BLOCK, len(mel)) - 1) * HOP + FRAME) / rate
    batch = pa.record_batch([pa.ExtensionArray.from_storage(kind, values), pa.array(start), pa.array(end)], ["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (n x BLOCK x BANDS) of such a stream, and their starts and ends in seconds (n x 2)."""
    import pyarrow as pa

    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    blocks = table.column("log_mel").chunk(0).to_numpy_ndarray() if len(table) else np.zeros((0, BLOCK, BANDS), np.float16)
    return blocks, np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], axis=1)


def features_of(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """Log-mel frames, segments and the rate after resampling of 8-bit unsigned samples."""
    new = rate * UP / DOWN
    mel, level = log_mel(np.frombuffer(samples, np.uint8), new)
    return mel, segments(level), new


def clips(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a WAV clip, stored in the shared folder and read back."""
    bounded_batches(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            made = [payload_of(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(scan, "doc_id long, n_bytes long, media binary"), "clips")


def audio_features(stored: DataFrame) -> DataFrame:
    """For clips (doc_id, n_bytes, media): the samples read back, tensors, segments in seconds and a short summary."""
    bounded_batches(stored.sparkSession)

    def scan(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

        def made(rows):
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), span, pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "samples", "media", "tensors", "spans", "summary"])

        rows, held = [], 0
        for batch in batches:
            for doc, n, clip in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                samples, rate = from_wav(clip)
                mel, found, new = features_of(samples, rate)
                spans = [{"start_s": a * HOP / new, "end_s": ((b - 1) * HOP + FRAME) / new} for a, b in found]
                mean = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64) + 0.0)
                summary = f"frames={len(mel)};segments={len(found)};active={sum(b - a for a, b in found)};mean={mean}"
                rows.append((doc, n, samples, clip, as_tensors(mel, new), spans, summary))
                held += 3 * len(clip)
                if held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return stored.mapInArrow(scan, "doc_id long, n_bytes long, samples binary, media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>, summary string")


def stored_features(features: DataFrame) -> DataFrame:
    """Lengths and checksums of samples and clips, with tensors and spans, stored in the shared folder and read back."""
    tail = F.substring("samples", -ALIGN, ALIGN)
    rows = features.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("summary").alias("feature"), "tensors", "spans",
    )
    return written(rows, "features")


def digests(stored: DataFrame) -> DataFrame:
    """stored_features with the checksum of the tensors and the spans as text (seconds, start-end) in their place."""
    spans = F.transform("spans", lambda s: F.format_string("%.4f-%.4f", s["start_s"], s["end_s"]))
    kept = [c for c in stored.columns if c not in ("tensors", "spans")]
    return stored.select(*kept, F.crc32("tensors").alias("tensors_crc32"), F.length("tensors").cast("long").alias("tensors_bytes"), F.array_join(spans, ",").alias("spans"))
