"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: sketches find them, sets decide.

SimHash fingerprints alone can't find them: texts at 0.8 differ in some 10 of 64 bits, 13 and more by chance, and keys
that cover this distance are hardly selective. So a text also has BANDS keys of ROWS minimum hashes each; two texts at
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9999 at 0.8 and more above. Candidates are
the texts that share such a key, and those whose fingerprints the Golay keys link. All of them are held against the bar
by their shingles, as 64-bit hashes, and only verified pairs link.

The texts of a key are compared in chunks, each with the key's least text, and what this leaves apart with all chunks
(see linking): a group of copies, however large, is read about once.

Shingles are op8's but for their length: words of the text with A-Z lower-cased, and a shorter text is one shingle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, spread_join
from .common import bounded_batches, written
from .linking import minors_against_all
from .simhash import links, majority

SHINGLE, BAR = 5, 0.8
ROWS, BANDS = 6, 32
#: Documents of a candidate group that are compared at a time with as many others.
CHUNK = 256
#: Numbers up to which a list of documents (16 bytes each) is broadcast.
SMALL_LIST = 1 << 21

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes (XXH64) of a text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(SHINGLE, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + k]), SHINGLE) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1))


class Sets:
    """Sets of hashes, laid end to end, so that one of them is compared with all at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def similarities(self, own: np.ndarray) -> np.ndarray:
        """Jaccard similarity of `own` and each set; two sets without members are alike."""
        both = np.zeros(len(self.sets), np.int64)
        if len(own):
            at = np.minimum(np.searchsorted(own, self.flat), len(own) - 1)
            both = np.bincount(self.owner[own[at] == self.flat], minlength=len(self.sets))
        union = self.sizes + len(own) - both
        return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys (int64); none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keys, fp) of the rows with a doc_id; equal digests mean equal sets of shingles.

    fp is op8's fingerprint over the set's hashes.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            digests, keys, fps = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(found))
                fps.append(majority(found))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "digest", "keys", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(scan, "doc_id long, digest binary, keys array<long>, fp long")


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ids at the bar or above that join ids as far as all such pairs would."""
    every, apart, out = Sets(sets), np.ones(len(sets), bool), []
    while apart.any():
        queue = [int(np.flatnonzero(apart)[0])]
        apart[queue[0]] = False
        while queue and apart.any():
            x = queue.pop()
            near = np.flatnonzero(apart & (every.similarities(sets[x]) >= BAR))
            out.extend((int(ids[x]), int(ids[y])) for y in near)
            apart[near] = False
            queue.extend(near.tolist())
    return out


def candidates(classes: DataFrame) -> DataFrame:
    """(pivot, node), node > pivot: the least class of each key with the others, and classes that fingerprints link."""
    rows = classes.select("least", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("least").alias("pivot"), F.max("least").alias("other"), F.count("*").alias("held")).where("pivot < other").select("key", "pivot", "held")
    shared = written(shared, "shared")
    by_key = spread_join(rows, shared, "key", "held", "least").select("pivot", F.col("least").alias("node"))
    alike = classes.groupBy("fp").agg(F.min("least").alias("node"), F.count("*").alias("held"))
    same = spread_join(classes.select("fp", "least"), alike, "fp", "held", "least").select(F.col("node").alias("pivot"), F.col("least").alias("node"))
    a, b = (alike.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in "ab")
    linked = links(alike.select("fp")).join(a, "a").join(b, "b").select(F.least("a_node", "b_node").alias("pivot"), F.greatest("a_node", "b_node").alias("node"))
    return by_key.union(same).union(linked).where("pivot < node").distinct()


def similar_documents(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, component_id): one row for each row of docs with a doc_id; component_id is the least doc_id reachable.

    Defined results: texts without words are alike; rows that share a doc_id are one document, which all of them link;
    rows with a null doc_id are left out; other columns are not read.
    """
    marked = written(sketches(docs), "sketches")
    classes = written(marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count("*").alias("held")), "classes")
    copies = spread_join(marked.select("doc_id", "digest"), classes.select("digest", "least", "held"), "digest", "held", "doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    pairs = written(candidates(classes), "candidates")
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("held"))
    dealt = spread_join(pairs, sizes.withColumn("chunks", F.ceil(F.col("held") / chunk).cast("int")), "pivot", "held", "node")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("held") / chunk).cast("int") - 1)).alias("chunk"))
    members = dealt.select("pivot", "chunk", "node").union(pivots.select("pivot", "chunk", F.col("pivot").alias("node")))

    def verify(table):
        import pyarrow as pa

        found = forest(table.column("node").to_numpy(), [shingles(x.as_py()) for x in table.column("text")])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def across(table):
        import pyarrow as pa

        sets, minor = [shingles(x.as_py()) for x in table.column("text")], table.column("minor").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        at, out = np.flatnonzero(~minor), []
        every = Sets([sets[i] for i in at])
        for x in np.flatnonzero(minor):
            hit = at[(every.similarities(sets[x]) >= BAR) & (root[at] != root[x])]
            _, first = np.unique(root[hit], return_index=True)
            out.extend((int(node[x]), int(node[y])) for y in hit[first])
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    # Only texts of candidates move; a list of them of known size is broadcast.
    wanted = written(members.select("node").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = written(texts.join(F.broadcast(wanted) if wanted.count() <= SMALL_LIST else wanted, "node", "left_semi"), "texts")
    found = written(members.join(texts, "node").groupBy("pivot", "chunk").applyInArrow(verify, "a long, b long"), "verified")
    large = members.join(sizes.where(F.col("held") > chunk).select("pivot"), "pivot", "left_semi")
    if not large.isEmpty():
        left = minors_against_all(large.select(F.col("pivot").alias("key"), "chunk", "node").distinct(), components(found), chunk)
        found = found.union(left.join(texts, "node").groupBy("key", "i", "j").applyInArrow(across, "a long, b long"))
    roots = components(copies.where("a <> b").union(found))
    return marked.join(roots, marked.doc_id == roots.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
