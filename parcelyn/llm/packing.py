"""Best-fit packing of tokenised documents into training sequences (vector bin packing).

A piece needs a vector: its tokens, one document, and its attention cost (length squared, as attention stays inside a
piece). A sequence has a capacity for each. Pieces go longest first into the open sequence that the score prefers under
every constraint; a new one opens only where none fits. Each task packs what it tokenises, window by window, so nothing
is shuffled; a window's least full sequences go back into the next window.

Defined results: null text is empty and gives one piece with the end id alone; a null doc_id is kept; repeated rows are
packed once each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: Rows of one output batch; each has at most `capacity` ids.
ROWS_OUT = 256
#: A sequence is closed at a window's end when so full; of the others at most CARRY are packed anew.
FULL, CARRY = 0.998, 64


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], select: str = "residual_norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length.

    capacities: tokens, documents and attention cost of a bin. select: "residual_norm" takes the bin with the least
    weighted norm of what would be left, "dot" the one with the largest weighted dot product of need and residual.
    Pieces of one length are placed together: after one of them, the chosen bin's norm only falls, so it stays first.
    """
    if select not in ("residual_norm", "dot"):
        raise ValueError(f"select: {select}")
    caps, w = np.array(capacities, np.float64), np.array(weights, np.float64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, firsts = np.unique(-lengths[order], return_index=True)
    left = np.empty((256, 3))
    active, made = np.empty(0, np.int64), 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for size, first, last in zip(-sizes, firsts, [*firsts[1:], len(order)], strict=True):
        need = np.array([size, 1.0, float(size) ** 2])
        if (need > caps).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        at = first
        while at < last:
            fits = active[(left[active] >= need).all(axis=1)] if len(active) else active
            if not len(fits):
                each = min(int((caps // need).min()), 1 << 40) if select == "residual_norm" else 1
                n = -(-(last - at) // each) if select == "residual_norm" else 1
                while made + n > len(left):
                    left = np.concatenate([left, np.empty_like(left)])
                k = np.arange(min(last - at, n * each))
                items = order[at : at + len(k)]
                bins[items], offsets[items] = made + k // each, k % each * size
                left[made : made + n] = caps - need * each
                left[made + n - 1] = caps - need * (len(k) - (n - 1) * each)
                active = np.concatenate([active, np.arange(made, made + n)])
                active = active[left[active, 0] >= smallest]
                made, at = made + n, at + len(k)
                continue
            if select == "dot":
                best, each = fits[np.argmax((left[fits] / caps) @ (w * need / caps))], 1
            else:
                best = fits[np.argmin((((left[fits] - need) / caps) ** 2) @ w)]
                each = int((left[best] // need).min())
            k = np.arange(min(last - at, each))
            items = order[at : at + len(k)]
            bins[items], offsets[items] = best, caps[0] - left[best, 0] + k * size
            left[best] -= need * len(k)
            at += len(k)
            if left[best, 0] < smallest:
                active = active[active != best]
    return bins, offsets


class _Window:
    """Pieces of one task that wait for their sequence."""

    def __init__(self, task: int, capacities, weights, select: str, unit: np.dtype):
        self.capacities, self.weights, self.select, self.unit = capacities, weights, select, unit
        self.next = task << 40
        self.rows: list[tuple] = []
        self.tokens = 0

    def add(self, doc, packed: bytes) -> None:
        cap, width = self.capacities[0], self.unit.itemsize
        n = len(packed) // width
        for piece, start in enumerate(range(0, n, cap)):
            self.rows.append((doc, piece, start, min(cap, n - start), packed[start * width : (start + cap) * width]))
        self.tokens += n

    def close(self, last: bool):
        import pyarrow as pa

        if not self.rows:
            return
        lengths = np.array([r[3] for r in self.rows], np.int64)
        bins, offsets = best_fit(lengths, self.capacities, self.weights, self.select)
        used = np.bincount(bins, lengths)
        again = np.zeros(len(used), bool)
        if not last:
            loose = np.flatnonzero(used < FULL * self.capacities[0])
            again[loose[np.argsort(used[loose], kind="stable")][:CARRY]] = True
        ids = self.next + np.cumsum(~again) - 1
        self.next += int((~again).sum())
        order = [i for i in np.lexsort((offsets, bins)).tolist() if not again[bins[i]]]
        for at in range(0, len(order), ROWS_OUT):
            part = order[at : at + ROWS_OUT]
            doc, piece, start, length, packed = zip(*map(self.rows.__getitem__, part), strict=True)
            wide = [np.frombuffer(x, self.unit).astype("<u4").tobytes() for x in packed]
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(wide, pa.binary()), pa.array(ids[bins[part]], pa.int64()), pa.array(offsets[part], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )
        self.rows = [r for r, b in zip(self.rows, bins.tolist(), strict=True) if again[b]]
        self.tokens = sum(r[3] for r in self.rows)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    select: str = "residual_norm",
    window_tokens: int = 1 << 22,
    special_as_text: bool = False,
) -> DataFrame:
    """Pieces of docs (doc_id, text) with their ids (little-endian unsigned 32-bit) and their place in a sequence.

    max_documents and max_attention are the other two capacities of a sequence; by default the most that `capacity`
    tokens can need, so that tokens alone bind. A task holds at most window_tokens tokens and one document besides.
    special_as_text: marks of special tokens in a text are ordinary text.
    """
    capacities = (capacity, max_documents or capacity, max_attention or capacity * capacity)
    bounded_batches(docs.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, special_as_text)
        end = np.array([end_id], enc.dtype).tobytes()
        window = _Window(TaskContext.get().partitionId(), capacities, weights, select, enc.dtype)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                window.add(doc, enc.packed(text or "") + end)
                if window.tokens >= window_tokens:
                    yield from window.close(False)
        yield from window.close(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)
