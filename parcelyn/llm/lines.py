"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A first scan fills two filters
over 64-bit hashes of keys: one of keys seen in a document, one of keys seen in a second one. Each builder reads many
partitions, so filters are few, and what two builders have both seen once is seen twice: the merged filter holds every
key of two documents or more. A second scan counts only keys that this filter suspects, by their SHA-256, which confirms
the repeats exactly. A third scan drops the lines of keys found in enough documents: all of them, or all but the first.

The filters' size follows the number of lines, BITS_PER_LINE each, up to MOST_BITS (128 MB). A larger corpus fills them
more: more keys are then suspected and counted, and the result is the same. Up to FEW_KEYS confirmed keys go to the tasks
as a broadcast. Beyond that, documents' suspected keys are joined to the confirmed ones, and the texts to what they lose.

Defined results: null text counts as one empty line and stays null; an empty line has no key and always stays; a row is a
document, so rows that repeat a doc_id count each; "first" is by doc_id (null last), then text, then line, and rows equal
in both are one document; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import spread_join
from .common import bounded_batches, fresh_name, quoted, written

#: White space that is stripped from a line's ends.
BLANK = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each line of the corpus, the bits that a key sets, and the most bits of a filter.
BITS_PER_LINE, HASHES, MOST_BITS = 6, 3, 1 << 30
#: Bytes of the slices in which filters are merged.
SLICE = 1 << 13
#: Confirmed keys up to which their table (32 bytes each) is broadcast.
FEW_KEYS = 1 << 18
#: Entries that a task's counts hold before they are passed on.
MOST_COUNTS = 1 << 17


def keys_of(text: bytes, min_chars: int = 1) -> list[bytes]:
    """The key of each line; empty for lines whose key has fewer than min_chars code points."""
    keys = [line.strip(BLANK) for line in text.lower().split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]
    return keys


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES x n bit numbers; bits is a power of two."""
    step, mask = (hashes >> np.uint64(32)) | np.uint64(1), np.uint64(bits - 1)
    return np.stack([(hashes + np.uint64(i) * step) & mask for i in range(HASHES)])


def _hit(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(axis=0)


def _fill(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, (at >> np.uint64(3)).ravel(), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)).ravel())


class TwoFilters:
    """Keys seen once, and keys seen again, as bits."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of keys, each as often as documents have it."""
        unique, n = np.unique(hashes, return_counts=True)
        at = positions(unique, self.bits)
        seen = _hit(self.once, at)
        _fill(self.twice, at[:, seen | (n > 1)])
        _fill(self.once, at[:, ~seen])

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return _hit(self.twice, positions(hashes, self.bits))


def _texts(column) -> Iterator[bytes]:
    import pyarrow as pa

    return (t or b"" for t in column.cast(pa.large_binary()).to_pylist())


def _distinct_keys(text: bytes, min_chars: int) -> list[bytes]:
    keys = set(keys_of(text, min_chars))
    keys.discard(b"")
    return list(keys)


def _hashes(keys: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def filter_bits(texts: DataFrame) -> int:
    """A power of two with BITS_PER_LINE bits at least for each line of column text, MOST_BITS at most."""
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(MOST_BITS, 1 << max(16, (lines * BITS_PER_LINE - 1).bit_length()))


def seen_twice(texts: DataFrame, bits: int, min_chars: int = 1, builders: int | None = None) -> np.ndarray:
    """The filter of keys that two rows of texts (column text) have, and of some others. bits / 8 bytes reach the driver."""
    spark = texts.sparkSession
    size = min(SLICE, bits >> 3)

    def build(batches):
        import pyarrow as pa

        both = TwoFilters(bits)
        for batch in batches:
            keys = [k for text in _texts(batch.column(0)) for k in _distinct_keys(text, min_chars)]
            if keys:
                both.add(_hashes(keys))
        for at in range(0, bits >> 3, size):
            if both.once[at : at + size].any():
                yield pa.record_batch([pa.array([at // size], pa.int32()), pa.array([both.once[at : at + size].tobytes()]), pa.array([both.twice[at : at + size].tobytes()])], ["slice", "once", "twice"])

    def merge(batches):
        import pyarrow as pa

        at, once, twice = None, None, None
        for batch in batches:
            for number, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if number == at:
                    twice, once = twice | b | (once & a), once | a
                    continue
                if at is not None:
                    yield pa.record_batch([pa.array([at], pa.int32()), pa.array([twice.tobytes()])], ["slice", "twice"])
                at, once, twice = number, a, b
        if at is not None:
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([twice.tobytes()])], ["slice", "twice"])

    builders = builders or 2 * spark.sparkContext.defaultParallelism
    parts = texts.coalesce(builders).mapInArrow(build, "slice int, once binary, twice binary")
    merged = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in merged.collect():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.twice, np.uint8)
    return out


class _Suspects:
    """The merged filter in a task."""

    def __init__(self, shared, bits: int, min_chars: int):
        self.filters = TwoFilters.__new__(TwoFilters)
        self.filters.bits, self.filters.twice, self.min_chars = bits, np.frombuffer(shared.value, np.uint8), min_chars

    def __call__(self, texts: list[bytes]) -> list[list[bytes]]:
        """The suspected keys of each text, once each."""
        keys = [_distinct_keys(t, self.min_chars) for t in texts]
        flat = [k for own in keys for k in own]
        if not flat:
            return keys
        hit, at, out = self.filters.suspects(_hashes(flat)), 0, []
        for own in keys:
            out.append([own[i] for i in np.flatnonzero(hit[at : at + len(own)])])
            at += len(own)
        return out


#: Order of occurrences: rows with an id first.
_FIRST = "struct<no_id: boolean, doc_id: bigint, text_id: binary, line: int>"


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def repeated_keys(texts: DataFrame, shared, bits: int, least: int, min_chars: int, first: bool) -> DataFrame:
    """(key, docs, first): SHA-256 of each key found in `least` rows or more, these rows, and its first occurrence."""

    def count(batches):
        import pyarrow as pa

        suspects, held = _Suspects(shared, bits, min_chars), {}

        def passed_on():
            firsts = [None if v[1] is None else dict(zip(("no_id", "doc_id", "text_id", "line"), v[1], strict=True)) for v in held.values()]
            kind = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("text_id", pa.binary()), ("line", pa.int32())])
            return pa.record_batch([pa.array(map(_digest, held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array(firsts, kind)], ["key", "docs", "first"])

        for batch in batches:
            every = list(_texts(batch.column(0)))
            for i, (text, own) in enumerate(zip(every, suspects(every), strict=True)):
                at, head = {}, None
                if first and own:
                    for line, k in enumerate(keys_of(text, min_chars)):
                        at.setdefault(k, line)
                    doc_id = batch.column(1)[i].as_py()
                    head = (doc_id is None, doc_id or 0, _digest(text))
                for k in own:
                    n, least_one = held.get(k, (0, None))
                    here = (*head, at[k]) if first else None
                    held[k] = (n + 1, here if least_one is None or (first and here < least_one) else least_one)
                if len(held) > MOST_COUNTS:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    counted = texts.mapInArrow(count, f"key binary, docs long, first {_FIRST}")
    return counted.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= least)


def drop_repeated_lines(docs: DataFrame, least: int = 2, keep: str = "first", min_chars: int = 1, bits: int | None = None, few_keys: int = FEW_KEYS) -> DataFrame:
    """docs without the lines whose key is in `least` documents or more, with n_lines and n_dropped.

    keep: "first" keeps the first occurrence of such a key in the corpus, "none" keeps none. The other lines stay, joined
    by line ends. New columns get a trailing underscore where docs has them already.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    bounded_batches(spark)
    name = {k: next(c for c in docs.columns if c.lower() == k) for k in ("doc_id", "text")}
    texts = docs.select(quoted(name["text"]).cast("string").alias("text"), quoted(name["doc_id"]).cast("long").alias("doc_id"))
    first = keep == "first"
    if not first:
        texts = texts.select("text")
    bits = bits or filter_bits(texts)
    shared = spark.sparkContext.broadcast(seen_twice(texts.select("text"), bits, min_chars).tobytes())
    keys = written(repeated_keys(texts, shared, bits, least, min_chars, first), "repeated-lines")
    small = keys.limit(few_keys + 1).count() <= few_keys

    names = [*docs.columns, fresh_name(docs, "n_lines"), fresh_name(docs, "n_dropped")]
    at_text, at_id = docs.columns.index(name["text"]), docs.columns.index(name["doc_id"])
    # Columns go by position, so that any names do.
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    table = {bytes(r.key): None if r.first is None else tuple(r.first) for r in keys.collect()} if small else None
    few = spark.sparkContext.broadcast(table) if small else None

    def drop(batches):
        import pyarrow as pa

        suspects = _Suspects(shared, bits, min_chars)
        for batch in batches:
            column = batch.column(at_text).cast(pa.large_binary())
            every = [t or b"" for t in column.to_pylist()]
            if small:
                found = [{k: few.value[d] for k in own if (d := _digest(k)) in few.value} for own in suspects(every)]
            else:
                given = [{bytes(x["key"]): x["first"] and tuple(x["first"].values()) for x in own or ()} for own in batch.column(len(schema) - 2).to_pylist()]
                found = [{k: g[d] for k in _distinct_keys(t, min_chars) if (d := _digest(k)) in g} if g else {} for t, g in zip(every, given, strict=True)]
            out, n, gone = [], [], []
            for i, (text, own) in enumerate(zip(every, found, strict=True)):
                if not own:
                    out.append(text)
                    n.append(text.count(b"\n") + 1)
                    gone.append(0)
                    continue
                head, parts, kept = None, text.split(b"\n"), []
                for line, (part, key) in enumerate(zip(parts, keys_of(text, min_chars), strict=True)):
                    if key and key in own:
                        if not first:
                            continue
                        if head is None:
                            doc_id = batch.column(at_id)[i].as_py()
                            head = (doc_id is None, doc_id or 0, _digest(text))
                        if (*head, line) != own[key]:
                            continue
                    kept.append(part)
                out.append(b"\n".join(kept))
                n.append(len(parts))
                gone.append(len(parts) - len(kept))
            columns = list(batch.columns[: len(schema) - 2])
            columns[at_text] = pa.array([None if t is None else o for t, o in zip(column.to_pylist(), out, strict=True)] if column.null_count else out, pa.binary()).cast(pa.string())
            yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    if small:
        return docs.mapInArrow(drop, schema).toDF(*names)

    def mark(batches):
        import pyarrow as pa

        suspects = _Suspects(shared, bits, min_chars)
        for batch in batches:
            every = list(_texts(batch.column(0)))
            found = [(_digest(t), _digest(k)) for t, own in zip(every, suspects(every), strict=True) for k in own]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["text_id", "key"])

    marks = texts.select("text").mapInArrow(mark, "text_id binary, key binary").groupBy("text_id", "key").agg(F.count("*").alias("rows"))
    hits = spread_join(marks, keys, "key", "docs", "text_id")
    by_text = hits.groupBy("text_id").agg(F.max("rows").alias("held"), F.collect_list(F.struct("key", "first")).alias("lost"))
    # A text is known by its SHA-256, so that rows of equal texts share what they lose.
    whole = docs.withColumn("text_id", F.unhex(F.sha2(F.coalesce(F.col(f"c{at_text}").cast("string"), F.lit("")), 256)))
    with_lost = spread_join(whole, written(by_text, "lost-lines"), "text_id", "held", f"c{at_id}", how="left")
    return with_lost.select(*docs.columns, "lost").mapInArrow(drop, schema).toDF(*names)
