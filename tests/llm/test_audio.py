"""Audio features against direct forms: filter, mel bands, segments, and what is stored against what is made."""

import zlib

import numpy as np
import pytest

from parcelyn.llm import audio as A


def direct_resample(samples, up=A.UP, down=A.DOWN, taps=A.TAPS):
    """Zeros between the samples, one long filter, every down-th output."""
    n = np.arange(up * taps)
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * (n - (len(n) - 1) / 2)) * np.hamming(len(n)) * up
    wide = np.zeros(len(samples) * up)
    wide[::up] = (samples.astype(float) - 128) / 128
    return np.convolve(wide, h)[: len(wide)][::down]


def direct_log_mel(samples, rate):
    """Frames of the clip with silence after it, into which the filter rings; their number is that of the clip alone."""
    x = direct_resample(np.concatenate([samples, np.full(2 * A.FRAME, 128, np.uint8)]))
    n = A.resampled_length(len(samples))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(60.0), mel(rate / 2), A.BANDS + 2)]
    rows, level = [], []
    for k in range(max(1, -(-(n - A.FRAME) // A.HOP) + 1)):
        frame = np.zeros(A.FRAME)
        part = x[k * A.HOP : k * A.HOP + A.FRAME]
        frame[: len(part)] = part
        windowed = frame * np.hanning(A.FRAME)
        power = [abs(sum(windowed * np.exp(-2j * np.pi * b * np.arange(A.FRAME) / A.FRAME))) ** 2 for b in range(A.FRAME // 2 + 1)]
        row = []
        for band in range(A.BANDS):
            low, mid, high = edges[band : band + 3]
            row.append(np.log(sum(p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for p, f in zip(power, np.arange(A.FRAME // 2 + 1) * rate / A.FRAME, strict=True)) + 1e-6))
        rows.append(row)
        level.append(10 * np.log10(np.mean(frame**2) + 1e-9))
    return np.array(rows), np.array(level)


def direct_segments(level):
    out, active = [], False
    for i, x in enumerate(level):
        if not active and x >= A.HIGH:
            active, start = True, i
        elif active and x < A.LOW:
            active = False
            out.append((start, i))
    return [*out, (start, len(level))] if active else out


@pytest.mark.parametrize("n", [64, 128, 1000, 5000])
def test_features_as_by_direct_forms(n):
    rng = np.random.default_rng(n)
    loud = np.repeat(rng.random(-(-n // 500)) > 0.5, 500)[:n]
    samples = np.where(loud, rng.integers(0, 256, n), rng.integers(126, 131, n)).astype(np.uint8)
    rate = A.RATE * A.UP / A.DOWN
    x = direct_resample(samples)
    assert A.resample(samples, 0, A.resampled_length(n)) == pytest.approx(x, abs=1e-12)
    mel, level = direct_log_mel(samples, rate)
    got, spans, new = A.features_of(samples.tobytes(), A.RATE)
    assert new == rate and got.shape == mel.shape
    assert got == pytest.approx(mel, abs=2e-3)
    assert spans == direct_segments(level)


def test_tensors_read_back():
    mel = np.random.default_rng(1).normal(size=(3 * A.BLOCK + 5, A.BANDS)).astype(np.float32)
    blocks, spans = A.from_tensors(A.as_tensors(mel, 12_000.0))
    assert blocks.shape == (4, A.BLOCK, A.BANDS) and blocks.reshape(-1, A.BANDS)[: len(mel)] == pytest.approx(mel, abs=5e-3)
    assert spans[1, 0] == A.BLOCK * A.HOP / 12_000 and spans[-1, 1] == ((len(mel) - 1) * A.HOP + A.FRAME) / 12_000


def test_stored_features(spark, odd_dir):
    """What the query reports is read back from storage, and is what the samples give."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")
    stored = A.stored_features(A.audio_features(A.clips(docs)))
    texts = [r.text for r in docs.collect()]
    made = {}
    for t in texts:
        payload, _ = A.payload_of(t)
        mel, spans, rate = A.features_of(payload, A.RATE)
        made[payload] = (mel, spans, rate)
    by_sum = {zlib.crc32(A.as_tensors(m, rate)): (s, rate) for m, s, rate in made.values()}
    rows = A.digests(stored).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans, rate = by_sum[r.tensors_crc32]
        assert r.spans == ",".join(f"{a * A.HOP / rate:.4f}-{((b - 1) * A.HOP + A.FRAME) / rate:.4f}" for a, b in spans)
    assert any(r.spans for r in rows)
