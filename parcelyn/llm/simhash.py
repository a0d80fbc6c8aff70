"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint: bit by bit majority of the XXH64 of a text's shingles. Equal fingerprints form a class; links are sought
between classes. The 64 bits are cut into segments of 22, 21 and 21, each read as a word of the perfect binary Golay
code [23, 12, 7]. All codewords within distance 4 of a word are its keys: 1 key, or 6 if the nearest codeword is 3 away;
two words that differ in at most 2 bits always share one. (A word 3 away from its nearest codeword is 4 away from five
more, reached by flipping five disjoint sets of 4 bits that cover all other 20 bits; so whichever 2 bits change, one of
the six codewords stays within 4.)

Pigeonhole for at most 4 differing bits in three segments: either each segment has at most 2 (a Golay key of all three
is shared, 36 bits), or one has 3 or 4, and of the others one is equal and the other has at most 1 (the equal segment
with a Golay key of the other is shared, 33 bits). Both kinds of key are emitted, candidates of a key are compared by
Hamming distance, and only links that join parts of a key's candidates are kept, which loses no reachability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, spread_join
from .common import bounded_batches, written
from .linking import minors_against_all

SEGMENTS = (22, 21, 21)
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the [23, 12, 7] code.
GOLAY = 0b101011100011
#: Distance at which fingerprints link, and the most that the keys cover.
DISTANCE = 4
#: Candidates of a key that one task compares at a time; larger sets are cut into such chunks, each of which is compared
#: together with the first PIVOTS candidates.
CHUNK, PIVOTS = 4096, 64
#: Up to so many candidates of a key are compared by shifting the sorted rows against themselves.
SHORT = 12


def _high_syndromes() -> np.ndarray:
    """Syndrome of each 12-bit high part alone; that of a low part is the part itself, and the code is linear."""
    s = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        s = np.where(s >> bit & 1, s ^ (GOLAY << (bit - 11)), s)
    return s


_HIGH = _high_syndromes()


def _syndrome(word: np.ndarray) -> np.ndarray:
    return _HIGH[word >> 11] ^ (word & 2047)


def golay_patterns() -> np.ndarray:
    """For each syndrome, the error patterns of weight 4 at most: 1 or 6, the rest of a row is -1."""
    out, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    one = 1 << np.arange(23)
    weights = [np.zeros(1, np.int64)]
    for _ in range(4):
        more = (weights[-1][:, None] | one[None, :]).ravel()
        weights.append(np.unique(more[(weights[-1][:, None] & one[None, :]).ravel() == 0]))
    for pattern, s in zip(np.concatenate(weights).tolist(), _syndrome(np.concatenate(weights)).tolist(), strict=True):
        out[s, filled[s]] = pattern
        filled[s] += 1
    return out


_patterns: list[np.ndarray] = []


def _golay_keys(word: np.ndarray) -> np.ndarray:
    """n x 6 message indices (12 bits) of the codewords within distance 4; -1 where there are fewer."""
    if not _patterns:
        _patterns.append(golay_patterns())
    e = _patterns[0][_syndrome(word)]
    return np.where(e < 0, -1, (word[:, None] ^ e) >> 11)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of uint64 fingerprints and, for each, the fingerprint's index. Two within DISTANCE share one at least."""
    shift, words = 64, []
    for bits in SEGMENTS:
        shift -= bits
        words.append((fingerprints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1))
    g = [_golay_keys(w) for w in words]
    n = len(fingerprints)
    who = np.arange(n)
    g3 = [x.reshape(n, *(6 if i == k else 1 for i in range(3))) for k, x in enumerate(g)]
    ok = (g3[0] >= 0) & (g3[1] >= 0) & (g3[2] >= 0)
    found = [((g3[0] << 24) | (g3[1] << 12) | g3[2])[ok]]
    index = [np.broadcast_to(who[:, None, None, None], ok.shape)[ok]]
    for kind, (equal, near) in enumerate(((a, b) for a in range(3) for b in range(3) if a != b), 1):
        ok = g[near] >= 0
        found.append(((kind << 36) | (words[equal][:, None] << 12) | g[near])[ok])
        index.append(np.broadcast_to(who[:, None], ok.shape)[ok])
    return np.concatenate(found), np.concatenate(index)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority of XXH64 (seed 42) over shingles of `shingle` words, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(first[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    n = len(words) - k + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. Null text has fingerprint zero."""
    bounded_batches(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64), pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within distance that join fps as far as all their links would: less than one for each fingerprint."""
    todo, out = np.arange(len(fps)), []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(fps[todo] ^ fps[x]) <= distance
            if near.any():
                hit = todo[near]
                out.append((np.full(len(hit), fps[x], np.uint64), fps[hit]))
                todo = todo[~near]
                queue.extend(hit.tolist())
    return out


def _links_of_runs(k: np.ndarray, f: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal keys (sorted)."""
    if not len(k):
        return []
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(k)]]))
    small, out = np.repeat(sizes <= SHORT, sizes), []
    for s in range(1, SHORT):
        i = np.flatnonzero((k[s:] == k[:-s]) & small[s:])
        if not len(i):
            break
        i = i[np.bitwise_count(f[i] ^ f[i + s]) <= distance]
        out.append((f[i], f[i + s]))
    for at in np.flatnonzero(sizes > SHORT).tolist():
        out.extend(_forest(f[first[at] : first[at] + sizes[at]], distance))
    return out


def _unique(pairs: list) -> list[tuple[np.ndarray, np.ndarray]]:
    if not pairs:
        return []
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return [(both[:, 0].copy(), both[:, 1].copy())]


def _as_batch(pairs: list, parts: list):
    """Links (chunk null), and (key, fingerprint, chunk) of keys with too many candidates to hold."""
    import pyarrow as pa

    links = sum(len(p[0]) for p in pairs)
    a = np.concatenate([np.zeros(0, np.int64), *(p[0].view(np.int64) for p in pairs), *(c[0] for c in parts)])
    b = np.concatenate([np.zeros(0, np.int64), *(p[1].view(np.int64) for p in pairs), *(c[1].view(np.int64) for c in parts)])
    chunk = np.concatenate([np.zeros(links, np.int32), *(c[2] for c in parts)]).astype(np.int32)
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(chunk, mask=np.arange(len(a)) < links)], ["a", "b", "chunk"])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough of them to reach whatever all links reach.

    A task holds at most CHUNK rows and a batch of one key. A key with more candidates is cut into chunks; those of its
    candidates that the chunks leave outside its largest component are then compared with all chunks.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys find at most {DISTANCE} differing bits")
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark)

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 1024):
                key, who = keys_of(fps[at : at + 1024])
                yield pa.record_batch([pa.array(key), pa.array(fps[at : at + 1024][who].view(np.int64))], ["key", "fp"])

    def compare(batches):
        k, f, large, seen, found, pivots = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0, [], None
        for batch in batches:
            k = np.concatenate([k, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy().view(np.uint64)])
            parts = []
            if large is not None:
                m = int(np.searchsorted(k, large, "right"))
                parts.append((k[:m], f[:m], (seen + np.arange(m)) // CHUNK))
                found.extend(near(pivots, f[:m]))
                k, f, seen = k[m:], f[m:], seen + m
            if len(k):
                large, open_run = None, int(np.searchsorted(k, k[-1]))
                found.extend(_links_of_runs(k[:open_run], f[:open_run], distance))
                k, f = k[open_run:], f[open_run:]
                if len(k) > CHUNK:
                    large, seen, pivots = k[0], len(k), f[:PIVOTS]
                    parts.append((k, f, np.arange(len(k)) // CHUNK))
                    found.extend(near(pivots, f))
                    k, f = k[:0], f[:0]
            if parts or sum(len(p[0]) for p in found) > 1 << 17:
                found = _unique(found)
                if parts or len(found[0][0]) > 1 << 16:
                    yield _as_batch(found, parts)
                    found = []
        yield _as_batch(_unique([*found, *_links_of_runs(k, f, distance)]), [])

    def near(pivots: np.ndarray, fps: np.ndarray) -> list:
        out = []
        for at in range(0, len(fps), CHUNK):
            out.extend(_forest(np.unique(np.concatenate([pivots, fps[at : at + CHUNK]])), distance))
        return out

    def across(table):
        import pyarrow as pa

        minor = table.column("minor").to_numpy()
        fps, root = table.column("node").to_numpy().view(np.uint64), table.column("root").to_numpy()
        pairs, all_fps, all_roots = [], fps[~minor], root[~minor]
        for x, own in zip(fps[minor], root[minor], strict=True):
            hit = np.flatnonzero((np.bitwise_count(all_fps ^ x) <= distance) & (all_roots != own))
            _, first = np.unique(all_roots[hit], return_index=True)
            pairs.append((np.full(len(first), x, np.uint64), all_fps[hit[first]]))
        batch = _as_batch(_unique(pairs), [])
        return pa.Table.from_batches([batch.select(["a", "b"])])

    # A fingerprint becomes some 180 rows, so its few bytes are dealt evenly first.
    rows = distinct.select("fp").repartition(n).mapInArrow(emit, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    first = written(rows.mapInArrow(compare, "a long, b long, chunk int"), "links")
    direct, parts = first.where("chunk IS NULL").select("a", "b"), first.where("chunk IS NOT NULL")
    if parts.isEmpty():
        return direct
    members = parts.select(F.col("a").alias("key"), F.col("b").alias("node"), "chunk")
    left = minors_against_all(members, components(direct), CHUNK)
    return direct.union(left.groupBy("key", "i", "j").applyInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs; component_id is the least doc_id reachable by links.

    Defined results: null or wordless text has fingerprint zero and links like any other; a text with fewer words than
    a shingle is one shingle; rows that repeat a doc_id each get a row; a null doc_id counts as no id, so a component
    of such rows alone has a null id; an empty table gives an empty result; other columns are not read.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    # A class is known by its least doc_id, so that a component's root is its result; those without one come last.
    node = F.struct(F.col("least").isNull().alias("no_id"), F.coalesce("least", "fp").alias("value"))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")).select("fp", node.alias("node"), "held")
    classes = written(classes, "classes")
    a, b = (classes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in "ab")
    pairs = links(classes.select("fp"), distance).join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    rooted = classes.join(components(pairs), "node", "left").select("fp", "held", F.coalesce("root", "node").alias("root"))
    joined = spread_join(marked, written(rooted, "rooted"), "fp", "held", "doc_id")
    return joined.select("doc_id", "fp", F.when(~F.col("root.no_id"), F.col("root.value")).alias("component_id"))
