"""Token-id files by static range asymmetric numeral systems (rANS), in interleaved blocks.

A file set is a Parquet table of blocks and one of symbol frequencies that all blocks share. A block holds whole
documents in ascending doc_id order; its frame is self-contained but for the frequencies: LANES interleaved decoder
states, checkpoints (states and word offset at every SEEK_STEPS steps) from which parts of it decode in parallel, a
CRC-32 of the ids, and the 32-bit code words.

Defined results: null text is empty and gives the end id alone; null doc_id comes first; rows that repeat a doc_id are
kept, ordered by their texts; an empty table gives empty files and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, remove
from .tokens import encoder

LANES = 2048
SEEK_STEPS = 128
#: Frequencies sum to 2**PRECISION.
PRECISION = 20
#: States stay in [2**31, 2**63).
LOW = 1 << 31
#: A block is closed at so many ids; a longer document is one block.
BLOCK_TOKENS = 1 << 20
HEAD = struct.Struct("<4sIQQII")
MAGIC = b"RAN1"

RAW = "shard int, block int, first_token long, doc_ids array<long>, doc_tokens array<int>, ids binary"
BLOCKS = "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, frame binary"


def frequencies(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and their shares of 2**PRECISION, each at least 1."""
    symbols = np.array(sorted(counts), np.int64)
    if len(symbols) > 1 << PRECISION:
        raise ValueError("more symbols than frequencies can tell apart")
    n = np.array([counts[s] for s in symbols.tolist()], np.float64)
    share = np.maximum(1, np.floor(n / max(n.sum(), 1) * (1 << PRECISION))).astype(np.int64)
    short = (1 << PRECISION) - int(share.sum())
    by_size = np.argsort(-n, kind="stable")
    while len(symbols) and short:
        take = by_size if short > 0 else by_size[share[by_size] > 1]
        take = take[: abs(short)]
        step = np.sign(short) * max(1, abs(short) // max(1, len(symbols)))
        for i in take.tolist():
            change = max(step, 1 - share[i]) if step < 0 else step
            change = int(np.clip(change, -abs(short), abs(short)))
            share[i] += change
            short -= change
            if not short:
                break
    return symbols, share


class Coder:
    """Encodes and decodes frames under one frequency table."""

    def __init__(self, symbols: np.ndarray, share: np.ndarray):
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.base = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = share
        self.base[symbols] = np.cumsum(share) - share
        self.slot = np.repeat(symbols, share).astype(np.uint16 if size <= 1 << 16 else np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        n, lanes = len(ids), min(LANES, max(1, len(ids) // 64))
        steps = -(-n // lanes)
        freq, base = self.freq[ids], self.base[ids]
        if n and not freq.all():
            raise ValueError("an id that the frequency table doesn't have")
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        p, sh, room = np.uint64(PRECISION), np.uint64(32), np.uint64(63 - PRECISION)
        low32 = np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            f, b = freq[t * lanes : (t + 1) * lanes], base[t * lanes : (t + 1) * lanes]
            y = x[: len(f)]
            out = y >= (f << room)
            words.append((y[out] & low32).astype("<u4"))
            y = np.where(out, y >> sh, y)
            q = y // f
            x[: len(f)] = (q << p) + (y - q * f) + b
            if t and t % SEEK_STEPS == 0:
                marks.append((len(words), x.copy()))
        counts = np.cumsum([len(w) for w in words[::-1]]) if words else np.zeros(1, np.int64)
        seek = b"".join(struct.pack("<QQ", steps - k, int(counts[-1] - sum(len(w) for w in words[:k]))) + s.astype("<u8").tobytes() for k, s in reversed(marks))
        body = b"".join(w.tobytes() for w in reversed(words))
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        return HEAD.pack(MAGIC, lanes, n, len(body) // 4, len(marks), crc) + x.astype("<u8").tobytes() + seek + body

    def _run(self, x: np.ndarray, words: np.ndarray, at: int, first: int, last: int, n: int, lanes: int) -> np.ndarray:
        out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        mask, p, sh, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32), np.uint64(LOW)
        done = 0
        for t in range(first, last):
            k = min(lanes, n - t * lanes)
            y = x[:k]
            slot = y & mask
            sym = self.slot[slot]
            out[done : done + k] = sym
            done += k
            y = self.freq[sym] * (y >> p) + slot - self.base[sym]
            need = np.flatnonzero(y < low)
            y[need] = (y[need] << sh) | words[at : at + len(need)]
            at += len(need)
            x[:k] = y
        return out

    def decode(self, frame: bytes, part: int | None = None) -> np.ndarray:
        """All ids, checked; or those from checkpoint `part` (0: the start) to the next one."""
        magic, lanes, n, n_words, n_marks, crc = HEAD.unpack_from(frame)
        if magic != MAGIC:
            raise ValueError("not a frame")
        at, width = HEAD.size, 8 * lanes
        starts = [(0, 0, np.frombuffer(frame, "<u8", lanes, at))]
        at += width
        for _ in range(n_marks):
            step, word = struct.unpack_from("<QQ", frame, at)
            starts.append((step, word, np.frombuffer(frame, "<u8", lanes, at + 16)))
            at += 16 + width
        words = np.frombuffer(frame, "<u4", n_words, at).astype(np.uint64)
        steps = -(-n // lanes)
        if part is None:
            state = starts[0][2].astype(np.uint64)
            ids = self._run(state, words, 0, 0, steps, n, lanes)
            if (state != LOW).any() or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("checksum of a frame differs")
            return ids
        step, word, state = starts[part]
        return self._run(state.astype(np.uint64), words, word, step, starts[part + 1][0] if part < n_marks else steps, n, lanes)


def _raw_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, special_as_text: bool) -> DataFrame:
    """Range-partitioned by doc_id (a shard each), tokenised, in blocks of whole documents.

    Each task ends with a row of block -1, whose ids are the counts of all its ids (64-bit).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that share a doc_id are dealt by the beginning of their texts, which is in the order of the texts themselves.
    rows = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer_path, special_as_text), TaskContext.get().partitionId()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        at, block, first, ids, counts, packed = 0, 0, 0, [], [], []
        total = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)

        def row(block, first, ids, counts, whole):
            return pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([whole], pa.binary())],
                ["shard", "block", "first_token", "doc_ids", "doc_tokens", "ids"],
            )

        def flush():
            whole = b"".join(packed)
            total[:] += np.bincount(np.frombuffer(whole, enc.dtype), minlength=len(total))
            return row(block, first, ids, counts, whole)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = enc.packed(text) + end
                ids.append(doc)
                counts.append(len(got) // width)
                packed.append(got)
                at += counts[-1]
                if at - first >= BLOCK_TOKENS:
                    yield flush()
                    first, block, ids, counts, packed = at, block + 1, [], [], []
        if ids:
            yield flush()
        if at:
            yield row(-1, at, [], [], total.astype("<i8").tobytes())

    return rows.mapInArrow(blocks, RAW)


def _unit(tokenizer_path: str) -> str:
    return encoder(tokenizer_path).dtype.str


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, special_as_text: bool = False) -> None:
    """Encode every text of docs under `path`: blocks and frequencies. The table of frequencies is over all ids.

    special_as_text: marks of special tokens in a text are ordinary text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    unit, temporary = _unit(tokenizer_path), fresh_path(spark, "ids")
    _raw_blocks(docs, tokenizer_path, end_id, special_as_text).write.option("compression", "zstd").parquet(temporary)
    raw = spark.read.schema(RAW).parquet(temporary)

    def tally(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                got = np.frombuffer(packed.as_buffer(), "<i8")
                total = got.copy() if not len(total) else total + got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    # At most one row for each id of the vocabulary reaches the driver.
    counts = {r.symbol: r.n for r in raw.where("block < 0").select("ids").mapInArrow(tally, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}
    symbols, share = frequencies(counts)
    table = list(zip(symbols.tolist(), share.tolist(), strict=True))
    spark.createDataFrame(table, "symbol int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")

    def encode(batches):
        import pyarrow as pa

        coder = Coder(symbols, share)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = np.frombuffer(one.column(5)[0].as_buffer(), unit)
                yield pa.record_batch([one.column(0), one.column(1), one.column(2), pa.array([len(ids)], pa.int64()), one.column(3), one.column(4), pa.array([coder.encode(ids)], pa.binary())], ["shard", "block", "first_token", "n_tokens", "doc_ids", "doc_tokens", "frame"])

    raw.where("block >= 0").mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, temporary)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a file set: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    Blocks decode independently. Only the number of ids of each shard (one row a partition) reaches the driver.
    """
    bounded_batches(spark)
    table = spark.read.parquet(f"{path}/frequencies").orderBy("symbol").collect()
    symbols, share = np.array([r.symbol for r in table], np.int64), np.array([r.frequency for r in table], np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    base, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.shard):
        base[r.shard], total = total, total + r.n

    def decode(batches):
        import pyarrow as pa

        coder = Coder(symbols, share)
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, ids_of, n_of = (batch.column(i)[k].as_py() for i in range(4))
                ids = coder.decode(batch.column(4)[k].as_buffer().to_pybytes()).astype("<u4")
                ends = np.cumsum(n_of)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), n_of, strict=True)]
                out = [pa.array(ids_of, pa.int64()), pa.array(base[shard] + first + ends - n_of, pa.int64()), pa.array(n_of, pa.int64()), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.record_batch(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("shard", "first_token", "doc_ids", "doc_tokens", "frame").mapInArrow(decode, schema)
